"""Nowcast alignment, error metrics, periods, and score comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _keys(target: DataFrame) -> list[str]:
    return [c for c in ("model_id", "period") if c in target.columns]


def monthly_target(target: DataFrame) -> DataFrame:
    """Last valid target value of each month."""
    return target.filter(F.col("v").isNotNull()).groupBy(*_keys(target), F.trunc("d", "MM").alias("month")).agg(
        F.max_by("v", "d").alias("target"))


def _at_offset(monthly: DataFrame, offset: int, name: str) -> DataFrame:
    keys = [c for c in monthly.columns if c not in ("month", "target")]
    return monthly.select(*keys, F.add_months("month", -offset).alias("month"), F.col("target").alias(name))


def weekly_pairs(nowcast: DataFrame, target: DataFrame, mode: str = "next_month") -> DataFrame:
    """Every nowcast with the target of its own or the following month."""
    m = monthly_target(target)
    return nowcast.withColumn("month", F.trunc("d", "MM")).join(
        _at_offset(m, 1 if mode == "next_month" else 0, "target"), [*_keys(target), "month"])


def last_friday_pairs(nowcast: DataFrame, target: DataFrame, mode: str = "next_month") -> DataFrame:
    """Each month's last Friday nowcast with the two targets around the step.

    ``reference`` is the month's own (or the previous) target and ``target`` the
    following (or the month's own); both must exist."""
    base = 0 if mode == "next_month" else -1
    group = [c for c in ("model_id", "period") if c in nowcast.columns]
    fridays = nowcast.filter(F.weekday("d") == 4).groupBy(*group, F.trunc("d", "MM").alias("month")).agg(
        F.max("d").alias("d"), F.max_by("v", "d").alias("v"))
    m = monthly_target(target)
    keys = [*_keys(target), "month"]
    return fridays.join(_at_offset(m, base, "reference"), keys).join(_at_offset(m, base + 1, "target"), keys)


def metrics(nowcast: DataFrame, target: DataFrame, mode: str = "next_month") -> DataFrame:
    """RMSE over all weeks, MAE over last Fridays, and direction win rate.

    Fewer than two pairs give an infinite error and a null rate.  Targets are
    one row per month, so the joins stay small beside the nowcasts."""
    group = [c for c in ("model_id", "period") if c in nowcast.columns]
    weekly = weekly_pairs(nowcast, target, mode)
    base = 0 if mode == "next_month" else -1
    directed = weekly.join(_at_offset(monthly_target(target), base, "reference"), [*_keys(target), "month"], "left")
    e = F.col("v") - F.col("target")
    sided = F.col("reference").isNotNull() & F.col("v").isNotNull()
    hit = F.signum(F.col("v") - F.col("reference")) == F.signum(F.col("target") - F.col("reference"))
    by_week = directed.groupBy(*group).agg(
        F.count(e).alias("n_weeks"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count_if(sided).alias("n_sides"),
        (F.avg(F.when(sided, hit.cast("double"))) * 100).alias("win_rate"))
    by_month = last_friday_pairs(nowcast, target, mode).groupBy(*group).agg(
        F.count(e).alias("n_months"), F.avg(F.abs(e)).alias("mae"))
    joined = nowcast.select(*group).distinct().join(by_week, group, "left").join(by_month, group, "left")
    enough = lambda n: F.coalesce(F.col(n), F.lit(0)) >= 2
    return joined.select(*group, F.when(enough("n_weeks"), F.col("rmse")).otherwise(INF).alias("rmse"),
                         F.when(enough("n_months"), F.col("mae")).otherwise(INF).alias("mae"),
                         F.when(enough("n_sides"), F.col("win_rate")).alias("win_rate"))


def assign_period(d: Column, train_end, validation_start, validation_end, data_end=None) -> Column:
    """training, validation, or observation (from a week after validation ends)."""
    day = lambda x: F.lit(x).cast("date")
    late = d >= F.date_add(day(validation_end), 7)
    return (F.when(d <= day(train_end), "training").when(d.between(day(validation_start), day(validation_end)), "validation")
            .when(late & (d <= day(data_end) if data_end is not None else F.lit(True)), "observation"))


def evaluate_periods(nowcast: DataFrame, target: DataFrame, train_end, validation_start, validation_end,
                     observation_end=None, mode: str = "next_month") -> DataFrame:
    """Metrics per model and period.

    Training and observation nowcasts meet only targets of their own period;
    validation may look at every target."""
    period = assign_period(F.col("d"), train_end, validation_start, validation_end, observation_end)
    tagged = nowcast.withColumn("period", period).filter(F.col("period").isNotNull())
    own = F.when(period.isin("training", "observation"), F.array(period, F.lit("validation"))).otherwise(F.array(F.lit("validation")))
    return metrics(tagged, target.withColumn("period", F.explode(own)), mode)


def target_statistics(target: DataFrame) -> DataFrame:
    keys = _keys(target)
    return target.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def period_bounds(aligned: DataFrame, train_end, validation_start, validation_end) -> DataFrame:
    """First and last date, and rows, of each model's periods."""
    p = assign_period(F.col("d"), train_end, validation_start, validation_end)
    return aligned.withColumn("period", p).filter("period is not null").groupBy("model_id", "period").agg(
        F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count(F.lit(1)).alias("n"))


def aligned_table(parts: list[DataFrame], target: DataFrame) -> DataFrame:
    """All Friday nowcasts with each target on the last Friday before its month."""
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    fridays = united.filter(F.weekday("d") == 4)
    last = fridays.groupBy("model_id", F.trunc("d", "MM").alias("month")).agg(F.max("d").alias("d"))
    placed = last.join(_at_offset(monthly_target(target), 1, "target"), ["model_id", "month"]).select("model_id", "d", "target")
    return fridays.join(placed, ["model_id", "d"], "left").select("model_id", "d", F.col("v").alias("nowcast"), "target")


def weighted_score(is_rmse: Column, oos_rmse: Column, is_win: Column, oos_win: Column, training_weight: float = 0.5) -> Column:
    """Struct of weighted win rate and RMSE; null RMSE marks an unusable score."""
    finite = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF), c)
    w = training_weight
    mix = lambda a, b: finite(b) if w == 0 else finite(a) if w == 1 else finite(a) * w + finite(b) * (1 - w)
    rmse = mix(is_rmse, oos_rmse)
    return F.struct(F.when(rmse.isNotNull(), mix(is_win, oos_win)).alias("win_rate"), rmse.alias("rmse"))


def compare_scores(a: Column, b: Column, rmse_tolerance: float = 1.0, win_tolerance: float = 5.0,
                   criterion: str = "hybrid", win_first: bool = True) -> Column:
    """1 when ``a`` is better, -1 when ``b`` is, 0 when equal.

    ``rmse`` and ``win_rate`` compare one measure; ``hybrid`` lets the first
    measure decide outside its tolerance and the second inside it."""
    by_rmse = F.signum(b["rmse"] - a["rmse"]).cast("int")
    aw, bw = a["win_rate"], b["win_rate"]
    by_win = (F.when(aw.isNull() & bw.isNull(), 0).when(aw.isNull(), -1).when(bw.isNull(), 1)
              .otherwise(F.signum(aw - bw).cast("int")))
    either = lambda x, y: F.when(x != 0, x).otherwise(y)
    if criterion == "rmse":
        decided = by_rmse
    elif criterion == "win_rate":
        decided = by_win
    elif win_first:
        far = aw.isNull() | bw.isNull() | (F.abs(aw - bw) > win_tolerance)
        decided = F.when(far, either(by_win, by_rmse)).otherwise(either(by_rmse, by_win))
    else:
        base = F.greatest(a["rmse"], b["rmse"])
        base = F.when(base == 0, 1e-10).otherwise(base)
        far = F.abs(a["rmse"] - b["rmse"]) / base * 100 > rmse_tolerance
        decided = F.when(far, by_rmse).otherwise(either(by_win, by_rmse))
    return (F.when(a["rmse"].isNull() & b["rmse"].isNull(), 0).when(a["rmse"].isNull(), -1)
            .when(b["rmse"].isNull(), 1).otherwise(decided))


def best_candidate(scored: DataFrame, keys: list[str], **rule) -> DataFrame:
    """Winner of each group when candidates are compared in name order.

    Comparison under tolerances is not transitive, so the order is part of the
    result: candidates fold one by one, sorted by name.  A group is one model's
    candidate sets, never more than its variables."""
    item = F.struct("candidate_id", F.col("score.win_rate").alias("win_rate"), F.col("score.rmse").alias("rmse"))
    kind = "struct<candidate_id:string,win_rate:double,rmse:double>"
    start = F.from_json(F.lit("{}"), kind)
    folded = F.aggregate(F.array_sort(F.collect_list(item.cast(kind))), start, lambda best, c: F.when(
        c["rmse"].isNotNull() & (compare_scores(c, best, **rule) > 0), c).otherwise(best))
    return scored.groupBy(*keys).agg(folded.alias("w")).select(*keys, "w.*")

"""Joins and alignment of series: spines, as-of joins, borrowing, resampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import calendar as cal
from tidemark.operators.window import drop_gappy


def spine(names: DataFrame, dates: Column) -> DataFrame:
    """Every name with every date of an array column: dense by construction,
    one generator per name rather than a join."""
    return names.select("series", F.explode(dates).alias("d"))


def friday_spine(names: DataFrame, start, end) -> DataFrame:
    return spine(names, cal.friday_sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))


def merge_panel(parts: list[DataFrame], start, end) -> DataFrame:
    """Full outer merge on the weekly spine, in long form.

    A series present in several parts keeps the first part's rows; dates
    outside the spine disappear and missing weeks become null."""
    united = None
    for pos, part in enumerate(parts):
        tagged = part.select("series", "d", "v", F.lit(pos).alias("_part"))
        united = tagged if united is None else united.unionByName(tagged)
    first = F.min("_part").over(Window.partitionBy("series"))
    kept = united.withColumn("_first", first).filter(F.col("_part") == F.col("_first"))
    by_date = kept.groupBy("series", "d").agg(F.max("v").alias("v"))
    return friday_spine(united.select("series").distinct(), start, end).join(by_date, ["series", "d"], "left")


def to_wide(panel: DataFrame, names: list[str]) -> DataFrame:
    """One column per named series, in the given order (target first)."""
    return panel.groupBy("d").pivot("series", names).agg(F.first("v", ignorenulls=True))


def align_series(obs: DataFrame, how: str = "inner", fill: str | None = None,
                 first: str | None = None, last: str | None = None) -> DataFrame:
    """Index alignment of all series: common, any, first's or last's dates,
    then optional forward, backward or linear fill by position."""
    if how in ("left", "right"):
        dates = obs.filter(F.col("series") == (first if how == "left" else last)).select("d").distinct()
    else:
        counted = obs.groupBy("d").agg(F.countDistinct("series").alias("k"))
        if how == "inner":
            counted = counted.filter(F.col("k") == obs.select(F.countDistinct("series")).scalar())
        dates = counted.select("d")
    # The date set is bounded by the calendar, so it travels as one array.
    calendar = dates.select(F.sort_array(F.collect_set("d"))).scalar()
    grid = spine(obs.select("series").distinct(), calendar)
    return fill_gaps(grid.join(obs.select("series", "d", "v"), ["series", "d"], "left"), fill)


def fill_gaps(dense: DataFrame, fill: str | None) -> DataFrame:
    """Forward, backward or linear-by-position fill inside each series."""
    forward = Window.partitionBy("series").orderBy("d")
    backward = Window.partitionBy("series").orderBy(F.col("d").desc())
    if fill == "ffill":
        return dense.withColumn("v", F.last("v", ignorenulls=True).over(forward))
    if fill == "bfill":
        return dense.withColumn("v", F.last("v", ignorenulls=True).over(backward))
    if fill == "interpolate":
        at = F.when(F.col("v").isNotNull(), F.struct(F.col("_p").alias("p"), F.col("v").alias("v")))
        seen = (dense.withColumn("_p", F.row_number().over(forward))
                .withColumn("_a", F.last(at, ignorenulls=True).over(forward))
                .withColumn("_b", F.last(at, ignorenulls=True).over(backward)))
        a, b = F.col("_a"), F.col("_b")
        line = a["v"] + (b["v"] - a["v"]) * (F.col("_p") - a["p"]) / (b["p"] - a["p"])
        # After the last valid point the last value is carried; before the first, null.
        return seen.withColumn("v", F.coalesce("v", F.when(b.isNotNull(), line).otherwise(a["v"]))).drop("_p", "_a", "_b")
    return dense


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
         payload: list[str], nearest_days: int | None = None, prefix: str = "asof_") -> DataFrame:
    """As-of join by union and window, one shuffle on ``keys``.

    Backward by default: the last right row at or before the left time.  With
    ``nearest_days`` the closest right row either way within that many days,
    the later one on ties.  Right rows count even when their payload is null."""
    row = F.struct(F.col(right_time).cast("date").alias("t"), *[F.col(c).alias(c) for c in payload])
    r = right.select(*keys, F.col(right_time).cast("date").alias("_t"), F.lit(0).alias("_side"), row.alias("_r"))
    l = left.select(*keys, F.col(left_time).cast("date").alias("_t"), F.lit(1).alias("_side"),
                    F.struct(*left.columns).alias("_l"))
    both = r.unionByName(l, allowMissingColumns=True)
    before = F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_side"))
    if nearest_days is None:
        picked = before
    else:
        # Right rows at the same time sort first in both directions.
        after = F.last("_r", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(F.col("_t").desc(), "_side"))
        both = both.withColumn("_before", before).withColumn("_after", after)
        gap_b = F.datediff("_t", F.col("_before.t"))
        gap_a = F.datediff(F.col("_after.t"), "_t")
        picked = (F.when((gap_a <= nearest_days) & (gap_b.isNull() | (gap_a <= gap_b)), F.col("_after"))
                  .when(gap_b <= nearest_days, F.col("_before")))
    out = both.withColumn("_pick", picked).filter("_side = 1")
    return out.select("_l.*", *[F.col(f"_pick.{c}").alias(prefix + c) for c in ["t", *payload]])


def year_on_year(obs: DataFrame, difference: bool = False, months: int = 12) -> DataFrame:
    """Growth per cent, or plain difference, against the row nearest to
    ``months`` earlier within 30 days.  January and February come out null."""
    shifted = obs.select("series", "d", "v", F.add_months("d", -months).alias("_ref"))
    joined = asof(shifted, obs, ["series"], "_ref", "d", ["v"], nearest_days=30)
    change = F.col("v") - F.col("asof_v")
    value = change if difference else F.try_divide(change, F.col("asof_v")) * 100
    return joined.select("series", "d", F.when(~F.month("d").isin(1, 2), value).alias("v"))


def lag_pairs(obs: DataFrame, target: str, max_lag: int) -> DataFrame:
    """Position-paired rows of every candidate with the target at each lag.

    Positions count each series' own rows; ``x[t + lag]`` meets ``y[t]`` and
    both sides are cut to the shorter series.  The target, one row per date at
    most, is a broadcast variable and a candidate one array by date, so pairs
    are written out from arrays, without a join."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("d", F.col("v").cast("double").alias("v")))), lambda r: r["v"])
    one = obs.filter(F.col("series") == target).agg(ordered.alias("v")).first()["v"]
    shared = obs.sparkSession.sparkContext.broadcast([float("nan") if v is None else v for v in one])
    candidates = obs.filter(F.col("series") != target).groupBy(F.col("series").alias("candidate")).agg(ordered.alias("v"))

    def pairs(batches):
        x = np.array(shared.value, float)
        for batch in batches:
            for name, values in zip(batch.column(0), batch.column(1)):
                y = np.array([float("nan") if v is None else v for v in values.as_py()], float)
                n = min(len(x), len(y))
                for lag in range(-min(max_lag, n - 1), min(max_lag, n - 1) + 1):
                    py = np.arange(max(0, -lag), n - max(0, lag))
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(name, len(py)), pa.repeat(pa.scalar(lag, pa.int32()), len(py)), pa.array((py + lag + 1).astype(np.int32)), pa.array((py + 1).astype(np.int32)),
                         pa.array(x[py + lag], from_pandas=True), pa.array(y[py], from_pandas=True)], ["candidate", "lag", "px", "py", "x", "y"])

    return candidates.mapInArrow(pairs, "candidate string, lag int, px int, py int, x double, y double")


def weekly_windows(obs: DataFrame, first: Column, last: Column) -> DataFrame:
    """Facts of each Saturday-to-Friday window between two Fridays: its valid
    values.  All rows outside are one window without a Friday."""
    seen = F.when(F.col("v").isNotNull(), F.col("d"))
    friday = cal.week_ending(F.col("d"))
    return obs.groupBy("series", F.when(friday.between(first, last), friday).alias("friday")).agg(
        F.max_by("v", seen).alias("last_v"), F.min_by("v", seen).alias("first_v"), F.min(seen).alias("first_d"), F.count("v").alias("n"))


def align_weekly(obs: DataFrame, start, end, borrow: bool = True) -> DataFrame:
    """Dense weekly panel: last value of each week; an empty week may copy the
    first value of a following week that holds at least two.

    Adds ``borrowed_from``, the donor date, null where nothing was borrowed.

    One pass: the windows of a series are put in order and each writes its own
    week and the empty ones up to the next, of which the last may borrow.  There
    is one exchange after the reduction to windows, by series, on which the gap
    rule goes on; no spine is joined."""
    day = lambda x: F.lit(x).cast("date")
    first, last = cal.week_ending(day(start)), F.date_sub(cal.week_ending(F.date_add(day(end), 1)), 7)
    w = Window.partitionBy("series").orderBy(F.col("_at").asc_nulls_first())
    placed = weekly_windows(obs, first, last).withColumnRenamed("friday", "_at").withColumn("_next", F.lead(F.struct("_at", "first_v", "first_d", "n")).over(w))
    # Before its first window in the range a series has empty weeks too.
    placed = placed.withColumn("_from", F.when(F.lag(F.lit(True)).over(w).isNull(), first).otherwise(F.col("_at")))
    to = F.coalesce(F.date_sub("_next._at", 7), last)
    weeks = F.when(F.col("_from") <= to, F.sequence("_from", to, F.expr("interval 7 days")))
    facts = F.struct("_at", "first_v", "first_d", "n")
    rows = placed.select("series", F.explode(weeks).alias("d"), "_at", "last_v", facts.alias("_own"), "_next")
    # Empty weeks before a series' first window look to that one, all others to the next.
    rows = rows.withColumn("_donor", F.when(F.col("d") < F.col("_at"), F.col("_own")).otherwise(F.col("_next")))
    own = F.when(F.col("d") == F.col("_at"), F.col("last_v"))
    can = F.lit(borrow) & own.isNull() & (F.col("_donor._at") == F.date_add("d", 7)) & (F.col("_donor.n") >= 2)
    return rows.select("series", "d", F.when(can, F.col("_donor.first_v")).otherwise(own).alias("v"), F.when(can, F.col("_donor.first_d")).alias("borrowed_from"))


def borrowing_log(aligned: DataFrame) -> DataFrame:
    return aligned.filter(F.col("borrowed_from").isNotNull()).select(
        "series", "borrowed_from", F.col("d").alias("borrowed_to"))


def borrow_move(obs: DataFrame, freq: str = "W") -> DataFrame:
    """Preview borrowing: values move instead of being copied.

    Weekly stamps first go to their Friday.  A window with rows but no value
    takes the first value of the adjacent next window when that holds two or
    more; the value lands on the window's latest row and the donor date turns
    null.  Repeated dates are averaged.  One pass over the rows of a series."""
    stamp = cal.nearest_friday(F.col("d")) if freq == "W" else F.col("d")
    number = (F.floor(F.datediff(cal.week_ending(stamp), F.lit("1970-01-02").cast("date")) / 7)
              if freq == "W" else cal.dekad_number(stamp)).cast("int")
    placed = obs.select("series", F.col("d").alias("_orig"), stamp.alias("d"), "v", number.alias("_w"))
    valid = F.col("v").isNotNull()
    rows = placed.groupBy("series", "_w", "d").agg(
        F.avg("v").alias("v"), F.count("v").alias("n"),
        F.min_by(F.when(valid, F.col("v")), F.when(valid, F.col("_orig"))).alias("first_v"))
    # Frames of whole windows by their number: this one, the next, the one before.
    at = lambda k: Window.partitionBy("series").orderBy("_w").rangeBetween(k, k)
    n, donor = F.sum("n"), F.min(F.when(F.col("n") > 0, F.struct("d", "first_v")))
    placed = rows.select("series", "d", "v", n.over(at(0)).alias("_n"), n.over(at(1)).alias("_n_next"), n.over(at(-1)).alias("_n_before"),
                         F.max("d").over(at(0)).alias("_target"), donor.over(at(0)).alias("_own"), donor.over(at(1)).alias("_donor"))
    takes = (F.col("_n") == 0) & (F.col("_n_next") >= 2) & (F.col("d") == F.col("_target"))
    gives = (F.col("_n_before") == 0) & (F.col("_n") >= 2) & (F.col("d") == F.col("_own.d"))
    return placed.select("series", "d", F.when(takes, F.col("_donor.first_v")).when(~F.coalesce(gives, F.lit(False)), F.col("v")).alias("v"))


def daily_to_weekly(obs: DataFrame) -> DataFrame:
    """Mean of each Saturday-to-Friday week."""
    return obs.groupBy("series", cal.week_ending(F.col("d")).alias("d")).agg(F.avg("v").alias("v"))


def _last_per_friday(obs: DataFrame, friday: Column) -> DataFrame:
    valid = F.col("v").isNotNull()
    return obs.groupBy("series", friday.alias("friday")).agg(
        F.max_by(F.col("v"), F.when(valid, F.col("d"))).alias("v")).withColumnRenamed("friday", "d")


def periodic_to_friday(obs: DataFrame, period: str | None) -> DataFrame:
    """Each stamp to the nearest Friday of its month, quarter or year (or any),
    the last valid value winning."""
    return _last_per_friday(obs, cal.period_friday(F.col("d"), period))


def dekad_to_weekly(obs: DataFrame, start, end, borrow: bool = True) -> DataFrame:
    """Dekad stamps only, each to its Friday, then weekly alignment."""
    stamped = obs.filter(cal.is_dekad_date(F.col("d")))
    return align_weekly(_last_per_friday(stamped, cal.dekad_friday(F.col("d"))), start, end, borrow)


def align_frequency(obs: DataFrame, freq: str, start, end, borrow: bool = True) -> DataFrame:
    """Weekly version of series of one frequency code."""
    if freq == "D":
        return daily_to_weekly(obs)
    if freq == "W":
        return align_weekly(obs, start, end, borrow).select("series", "d", "v")
    if freq == "K":
        return dekad_to_weekly(obs, start, end, borrow).select("series", "d", "v")
    return periodic_to_friday(obs, {"M": "month", "Q": "quarter", "Y": "year"}[freq])


def align_and_gate(obs: DataFrame, threshold: int, start, end, borrow: bool = True,
                   target_freq: str = "W") -> DataFrame:
    """All frequencies to weekly with the gap rule at the right moment.

    Series at or above the target's frequency are aligned and then gated;
    coarser ones are gated on their own dates and then aligned.  Input carries
    ``freq``; each frequency is one branch of a single plan."""
    out = None
    for freq, level in vocab.PREP_LEVEL.items():
        part = obs.filter(F.col("freq") == freq).select("series", "d", "v")
        if level <= vocab.PREP_LEVEL[target_freq]:
            aligned = drop_gappy(align_frequency(part, freq, start, end, borrow), threshold, start, end)
        else:
            aligned = align_frequency(drop_gappy(part, threshold, start, end), freq, start, end, borrow)
        tagged = aligned.withColumn("freq", F.lit(freq))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def infer_frequency(obs: DataFrame) -> DataFrame:
    """Label per series from the median gap of its valid dates, in whole days."""
    valid = obs.filter(F.col("v").isNotNull()).select("series", "d")
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("series").orderBy("d")))
    stats = valid.withColumn("gap", gap).groupBy("series").agg(F.floor(F.median("gap")).alias("days"))
    label = F.when(F.col("days").isNull(), "Undetermined")
    for name, (lo, hi) in vocab.GAP_BANDS.items():
        label = label.when(F.col("days").between(lo, hi), name)
    return stats.select("series", "days", label.otherwise("Irregular").alias("label"))


def resample(obs: DataFrame, label: str, method: str = "mean") -> DataFrame:
    """Resample every series; empty buckets vanish, except that ``sum`` yields
    0 for each bucket between the frame's first and last."""
    origin = obs.select(F.min("d")).scalar() if label == "Ten_Day" else None
    v, d = F.col("v"), F.col("d")
    when = F.when(v.isNotNull(), d)
    pick = {"mean": F.avg(v), "last": F.max_by(v, when), "first": F.min_by(v, when),
            "sum": F.sum(v), "median": F.median(v)}[method]
    grouped = obs.groupBy("series", cal.bucket(d, label, origin).alias("bucket")).agg(pick.alias("v"))
    grouped = grouped.withColumnRenamed("bucket", "d")
    if method != "sum":
        return grouped.filter(F.col("v").isNotNull())
    bounds = grouped.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    buckets = bounds.select(cal.bucket_sequence(F.col("lo"), F.col("hi"), label)).scalar()
    dense = spine(grouped.select("series").distinct(), buckets)
    return dense.join(grouped, ["series", "d"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def common_frequency(labels: DataFrame) -> str | None:
    """Lowest usable frequency when several are present (at most six rows reach
    the driver), else None."""
    found = {r[0] for r in labels.filter(F.col("label").isin(list(vocab.EXPLORE_PRIORITY))).select("label").distinct().collect()}
    return max(found, key=vocab.EXPLORE_PRIORITY.get) if len(found) > 1 else None


def unify_frequencies(obs: DataFrame, target_label: str | None = None, method: str = "mean") -> DataFrame:
    """Resample everything to the lowest (or requested) frequency if mixed."""
    label = common_frequency(infer_frequency(obs))
    return obs if label is None else resample(obs, target_label or label, method)


def date_overlap(obs: DataFrame) -> DataFrame:
    """Dates valid in every series, and their share of the longest series."""
    valid = obs.filter(F.col("v").isNotNull()).select("series", "d").distinct()
    per_series = valid.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    size = per_series.agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("k"))
    shared = valid.groupBy("d").agg(F.count(F.lit(1)).alias("k"))
    common = shared.filter(F.col("k") == size.select("k").scalar()).agg(F.count(F.lit(1)).alias("n_common"))
    longest = size.select("longest").scalar()
    return common.select("n_common", longest.alias("longest"),
                         F.try_divide(F.col("n_common"), longest).alias("overlap"))


def common_dates(obs: DataFrame) -> DataFrame:
    """Intersection of the valid-date sets of all series."""
    valid = obs.filter(F.col("v").isNotNull())
    return (valid.groupBy("d").agg(F.countDistinct("series").alias("k"))
            .filter(F.col("k") == valid.select(F.countDistinct("series")).scalar()).select("d"))


def unify_for_pairs(obs: DataFrame, method: str = "mean") -> DataFrame:
    """As :func:`unify_frequencies`, and also resample when all series share a
    monthly or coarser label but fewer than half their dates coincide."""
    labels = infer_frequency(obs)
    label = common_frequency(labels)
    if label is None:
        same = {r[0] for r in labels.select("label").distinct().collect()} & set(vocab.EXPLORE_PRIORITY)
        if len(same) == 1 and same <= {"Monthly", "Quarterly", "Annual"}:
            few = date_overlap(obs).filter((F.col("overlap") < 0.5)).count()
            label = same.pop() if few else None
    return obs if label is None else resample(obs, label, method)

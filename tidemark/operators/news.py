"""Attribution of nowcast revisions to single data releases.

Tables are keyed by model and month.  Factor vectors are small maps.  States in
force are looked up per model and date and gains per model and variable, groups
that the calendar bounds; totals of a month come from aggregates joined back,
so no model or month has to fit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.operators.rank import rank_descending

KEYS = ["model_id", "month"]

# Interval width, error assumed for exact hits, near-zero bound.
INTERVAL_Z = 1.96
ERROR_SHARE = 0.1
EXACT_ERROR = 0.01
NEAR_ZERO = 1e-10
# Driver thresholds and weights of the driver score.
DRIVER_SHARE = 0.1
PRIMARY_RANK, SECONDARY_RANK = 3, 10
STABLE_HIGH, STABLE_LOW = 0.8, 0.2
TOP_VARIABLES = 5


def _vector(value: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", value))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(b[e["key"]], F.lit(0.0)))


def _dated_vectors(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per key, the date-ordered array of factor vectors."""
    per_date = rows.groupBy(*keys, "d").agg(_vector(value).alias("vec"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("d"), F.map_entries("vec").alias("e"))))
    return per_date.groupBy(*keys).agg(ordered.alias(name))


def prior_predictions(loadings: DataFrame, states: DataFrame) -> DataFrame:
    """Prediction of every variable at every date from the prior states."""
    per_model = _dated_vectors(states, ["model_id"], "state", "states")
    h = loadings.groupBy("model_id", "variable").agg(_vector("loading").alias("h"))
    rows = h.join(per_model, "model_id").select("model_id", "variable", "h", F.explode("states").alias("s"))
    return rows.select("model_id", "variable", F.col("s.d").alias("d"), _dot(F.col("h"), F.map_from_entries("s.e")).alias("expected"))


def releases(observed: DataFrame, loadings: DataFrame, states: DataFrame, target: str, month: str | None = None) -> DataFrame:
    """Observed values of non-target variables with their prior expectation.

    ``month`` (``YYYY-MM``) restricts to one target month; otherwise every
    month is prepared.  Nulls are no releases."""
    seen = observed.filter(F.col("observed").isNotNull() & (F.col("variable") != target))
    if month is not None:
        first = F.to_date(F.lit(month + "-01"))
        seen = seen.filter(F.col("d").between(first, F.last_day(first)))
    h = loadings.groupBy("model_id", "variable").agg(_vector("loading").alias("h"))
    # States in force are looked up once per model and date, then joined by value.
    vecs = states.groupBy("model_id", "d").agg(_vector("state").alias("vec"))
    in_force = align.asof(seen.select("model_id", "d").distinct(), vecs, ["model_id"], "d", "d", ["vec"])
    joined = seen.join(h, ["model_id", "variable"]).join(in_force.select("model_id", "d", "asof_vec"), ["model_id", "d"])
    out = joined.filter(F.col("asof_vec").isNotNull()).select(
        "model_id", F.trunc("d", "MM").alias("month"), F.col("d").alias("ts"), "variable", "observed",
        _dot(F.col("h"), F.col("asof_vec")).alias("expected"))
    gap = F.abs(F.col("observed") - F.col("expected"))
    return out.withColumn("measurement_error", F.when(gap == 0, EXACT_ERROR).otherwise(gap * ERROR_SHARE))


def impacts(rel: DataFrame, gains: DataFrame, target_loading: DataFrame) -> DataFrame:
    """Effect of each release on the target, its gain norm and interval.

    Impact is the target's deviation times the sum over factors of target
    loading times gain times surprise, with the gain in force at the date."""
    lam = target_loading.select("model_id", "factor", F.col("loading").alias("_l"), F.col("target_std").alias("_sd"))
    k = gains.join(lam, ["model_id", "factor"]).groupBy("model_id", "variable", "d").agg(
        (F.sum(F.col("gain") * F.col("_l")) * F.max("_sd")).alias("effect"), F.sqrt(F.sum(F.col("gain") * F.col("gain"))).alias("norm"))
    joined = align.asof(rel, k, ["model_id", "variable"], "ts", "d", ["effect", "norm"])
    valued = joined.filter(F.col("asof_t").isNotNull()).select(
        *rel.columns, (F.col("asof_effect") * (F.col("observed") - F.col("expected"))).alias("impact"),
        F.col("asof_norm").alias("gain_norm"))
    margin = F.col("measurement_error") * F.when(F.col("impact") != 0, F.abs("impact")).otherwise(1.0) * INTERVAL_Z
    return valued.withColumn("low", F.col("impact") - margin).withColumn("high", F.col("impact") + margin)


def _with_total(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a per-key total by aggregate and join, never one task per key."""
    return rows.join(rows.groupBy(*KEYS).agg(F.sum(value).alias(name)), KEYS)


def contributions(imp: DataFrame) -> DataFrame:
    """Share of each release in the total absolute impact, per cent."""
    total = _with_total(imp, F.abs("impact"), "_abs")
    pct = F.when(F.col("_abs") > 0, F.abs("impact") / F.col("_abs") * 100).otherwise(0.0)
    return total.withColumn("contribution_pct", pct).withColumn("is_positive", F.col("impact") > 0).drop("_abs")


def baselines(rel: DataFrame, nowcast: DataFrame) -> DataFrame:
    """Nowcast in force at the start of each month."""
    months = rel.select(*KEYS).distinct()
    return align.asof(months, nowcast, ["model_id"], "month", "d", ["v"]).select(*KEYS, F.col("asof_v").alias("baseline"))


def variable_totals(contrib: DataFrame) -> DataFrame:
    """Total, average and share of each variable; shares use single impacts."""
    per = contrib.groupBy(*KEYS, "variable").agg(
        F.sum("impact").alias("total_impact"), F.count(F.lit(1)).alias("release_count"), F.sum(F.abs("impact")).alias("_a"))
    out = _with_total(per, F.col("_a"), "_abs")
    share = F.when(F.col("_abs") > 0, F.abs("total_impact") / F.col("_abs") * 100).otherwise(0.0)
    return out.select(*KEYS, "variable", "total_impact", "release_count",
                      (F.col("total_impact") / F.col("release_count")).alias("average_impact"), share.alias("contribution_pct"))


def normalize(contrib: DataFrame, nowcast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scale impacts so they add up to the month's change of the nowcast.

    The second table states the factor, or why there is none: fewer than two
    nowcasts in the month, no change, or impacts that cancel out."""
    month = F.trunc("d", "MM").alias("month")
    change = nowcast.groupBy("model_id", month).agg(
        F.min_by("v", "d").alias("first_nowcast"), F.max_by("v", "d").alias("last_nowcast"), F.count("v").alias("n_nowcasts"))
    info = contrib.groupBy(*KEYS).agg(F.sum("impact").alias("raw_total"), F.sum(F.abs("impact")).alias("raw_abs")).join(change, KEYS, "left")
    actual = F.col("last_nowcast") - F.col("first_nowcast")
    problem = (F.when(F.coalesce("n_nowcasts", F.lit(0)) < 2, "too_few_nowcasts")
               .when(F.abs("raw_total") < NEAR_ZERO, "impacts_cancel").when(F.abs(actual) < NEAR_ZERO, "no_change"))
    info = info.select(*KEYS, "first_nowcast", "last_nowcast", actual.alias("actual_change"), "raw_total", "raw_abs",
                       problem.alias("problem"), F.when(problem.isNull(), actual / F.col("raw_total")).alias("scale"))
    scaled = contrib.join(info.filter("problem is null").select(*KEYS, "scale", "raw_abs"), KEYS)
    value = F.col("impact") * F.col("scale")
    out = scaled.withColumn("contribution_pct", F.abs("impact") / F.col("raw_abs") * 100).withColumn(
        "impact", value).withColumn("is_positive", F.col("impact") > 0).drop("scale", "raw_abs")
    return out, info.drop("raw_abs")


def rank_variables(contrib: DataFrame, method: str = "total_impact") -> DataFrame:
    """Variables of each month ranked by absolute total, absolute average,
    share, or frequency; equal values share a rank."""
    per = contrib.groupBy(*KEYS, "variable").agg(
        F.sum("impact").alias("total_impact"), F.avg("impact").alias("avg_impact"),
        F.sum("contribution_pct").alias("total_contribution_pct"), F.count(F.lit(1)).alias("release_count"),
        F.count_if("is_positive").alias("positive_count"), F.stddev_pop("impact").alias("consistency"),
        F.max(F.abs("impact")).alias("max_single_impact"))
    full = per.withColumn("negative_count", F.col("release_count") - F.col("positive_count")).withColumn(
        "impact_ratio", F.col("positive_count") / F.col("release_count"))
    value = {"total_impact": F.abs("total_impact"), "avg_impact": F.abs("avg_impact"),
             "contribution_pct": F.col("total_contribution_pct"), "frequency": F.col("release_count")}[method]
    return rank_descending(full, KEYS, value)


def key_drivers(contrib: DataFrame, threshold: float = DRIVER_SHARE, top_n: int = SECONDARY_RANK) -> DataFrame:
    """Variables with a large share or a high rank, scored and classified, with
    their pattern flags (frequent, high impact, stable up or down)."""
    ranked = rank_variables(contrib, "contribution_pct")
    most = ranked.groupBy(*KEYS).agg(F.max("release_count").alias("_max"))
    kept = ranked.join(most, KEYS).filter((F.col("total_contribution_pct") >= threshold * 100) | (F.col("rank") <= top_n))
    score = (F.col("total_contribution_pct") * 0.4 + F.col("release_count") / F.col("_max") * 100 * 0.3
             + F.col("impact_ratio") * 100 * 0.3)
    tier = F.when(F.col("rank") <= PRIMARY_RANK, "primary").when(F.col("rank") <= SECONDARY_RANK, "secondary").otherwise("other")
    scored = kept.withColumn("key_score", score).withColumn("tier", tier).drop("_max")
    mid = scored.groupBy(*KEYS).agg(F.median("release_count").alias("_f"), F.median("max_single_impact").alias("_m"))
    return scored.join(mid, KEYS).select(
        *scored.columns, (F.col("release_count") > F.col("_f")).alias("frequent"),
        (F.col("max_single_impact") > F.col("_m")).alias("high_impact"), (F.col("impact_ratio") >= STABLE_HIGH).alias("stable_up"),
        (F.col("impact_ratio") <= STABLE_LOW).alias("stable_down"))


def sign_split(contrib: DataFrame) -> DataFrame:
    """Positive and negative totals, shares, counts and balance per month."""
    i, up = F.col("impact"), F.col("is_positive")
    s = contrib.groupBy(*KEYS).agg(
        F.coalesce(F.sum(F.when(up, i)), F.lit(0.0)).alias("positive"), F.coalesce(F.sum(F.when(~up, i)), F.lit(0.0)).alias("negative"),
        F.count_if(up).alias("n_positive"), F.count_if(~up).alias("n_negative"))
    size = F.col("positive") + F.abs("negative")
    share = lambda c: F.when(size > 0, F.abs(c) / size).otherwise(0.0)
    return s.select("*", (F.col("positive") + F.col("negative")).alias("net"), share("positive").alias("positive_ratio"),
                    share("negative").alias("negative_ratio"),
                    F.when(F.col("negative") != 0, F.abs(F.col("positive") / F.col("negative"))).alias("balance"))


def top_by_sign(contrib: DataFrame, n: int = TOP_VARIABLES) -> DataFrame:
    """The variables with the largest positive and negative sums of each month."""
    per = contrib.groupBy(*KEYS, "is_positive", "variable").agg(F.sum("impact").alias("impact"))
    return rank_descending(per, [*KEYS, "is_positive"], F.abs("impact")).filter(F.col("rank") <= n)


def with_industry(contrib: DataFrame, industries: DataFrame) -> DataFrame:
    """Adds each variable's industry, ``Other`` where unknown."""
    return contrib.join(industries, "variable", "left").withColumn("industry", F.coalesce("industry", F.lit("Other")))


def industry_totals(contrib: DataFrame) -> DataFrame:
    """Impact, counts and signed sums per industry; shares by absolute totals."""
    i = F.col("impact")
    per = contrib.groupBy(*KEYS, "industry").agg(
        F.sum(i).alias("impact"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(i > 0, i)), F.lit(0.0)).alias("positive"),
        F.coalesce(F.sum(F.when(i < 0, i)), F.lit(0.0)).alias("negative"), F.sum(F.abs(i)).alias("_a"))
    out = _with_total(per, F.col("_a"), "_abs")
    return out.withColumn("contribution_pct", F.when(F.col("_abs") > 0, F.abs("impact") / F.col("_abs") * 100).otherwise(0.0)).drop("_a", "_abs")


def industry_by_date(contrib: DataFrame) -> DataFrame:
    """Date by industry table in long form, 0 where an industry has no release,
    with the positive and negative stacks."""
    i = F.col("impact")
    cells = contrib.groupBy(*KEYS, "ts", "industry").agg(
        F.sum(i).alias("impact"), F.sum(F.when(i > 0, i)).alias("positive"), F.sum(F.when(i < 0, i)).alias("negative"))
    names = contrib.groupBy("model_id").agg(F.collect_set("industry").alias("_i"))
    grid = contrib.select(*KEYS, "ts").distinct().join(names, "model_id").select(*KEYS, "ts", F.explode("_i").alias("industry"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return grid.join(cells, [*KEYS, "ts", "industry"], "left").select(
        *KEYS, "ts", "industry", zero("impact"), zero("positive"), zero("negative"))


def industry_ranking(totals: DataFrame, by: str = "impact", top_n: int | None = None) -> DataFrame:
    """Industries of each month by the absolute value of one column."""
    ranked = rank_descending(totals, KEYS, F.abs(by))
    return ranked if top_n is None else ranked.filter(F.col("rank") <= top_n)


def industry_extremes(totals: DataFrame) -> DataFrame:
    """Industry count and the strongest positive and negative industry."""
    return totals.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("industry", F.struct("positive", "industry")).alias("top_positive"), F.max("positive").alias("max_positive"),
        F.min_by("industry", F.struct("negative", "industry")).alias("top_negative"), F.min("negative").alias("max_negative"))


def data_flow(contrib: DataFrame, nowcast: DataFrame) -> DataFrame:
    """Releases with the nowcast in force at their date, newest date first."""
    dates = contrib.select("model_id", "ts").distinct()
    dated = align.asof(dates, nowcast, ["model_id"], "ts", "d", ["v"]).select("model_id", "ts", F.col("asof_v").alias("nowcast"))
    return contrib.join(dated, ["model_id", "ts"], "left").orderBy(F.col("ts").desc(), "model_id", "variable")


def date_summary(contrib: DataFrame) -> DataFrame:
    """Release count and signed sums per date, newest first."""
    i = F.col("impact")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return contrib.groupBy("model_id", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.sum(i).alias("total"), zero(F.when(i > 0, i)).alias("positive"),
        zero(F.when(i < 0, i)).alias("negative")).orderBy(F.col("ts").desc(), "model_id")


def model_summary(gains: DataFrame) -> DataFrame:
    """Steps, factors, variables, and gain size at each model's first step."""
    first = gains.groupBy("model_id").agg(F.min("d").alias("_first"))
    g = F.when(F.col("d") == F.col("_first"), F.abs("gain"))
    return gains.join(first, "model_id").groupBy("model_id").agg(
        F.countDistinct("d").alias("n_steps"), F.countDistinct("factor").alias("n_factors"),
        F.countDistinct("variable").alias("n_variables"), F.max(g).alias("max_gain"), F.avg(g).alias("mean_gain"))


def write_analysis(contrib: DataFrame, ranked: DataFrame, summary: DataFrame, path: str) -> None:
    """Impact rows, ranked contributions and the summary as CSV folders."""
    for name, df in (("impacts", contrib), ("contributions", ranked), ("summary", summary)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")

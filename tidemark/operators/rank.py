"""Ranks and ordered selections that survive hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BUCKETS = 64


def _bucketed(counts: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Distinct values with the value range ``_b`` they fall in.

    Each key has cuts of its own, approximate quantiles of its distinct values,
    so a key whose values lie close together is split as finely as any other.
    Cuts only split work, they never decide a rank."""
    probs = [i / buckets for i in range(1, buckets)]
    number = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col("_v")))
    if not keys:
        cuts = sorted(set(counts.approxQuantile("_v", probs, 0.005)))
        return counts.withColumn("_b", number(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", probs, 2000).alias("_cuts"))
    return counts.join(cuts, keys).withColumn("_b", number(F.col("_cuts"))).drop("_cuts")


def rank_descending(df: DataFrame, keys: list[str], value: Column, name: str = "rank",
                    buckets: int = BUCKETS) -> DataFrame:
    """Competition rank (``1 +`` rows with a larger value) within ``keys``.

    Rows are first counted per distinct value, then ranked inside value ranges
    whose totals give the offsets, so neither one hot group nor one repeated
    value has to fit in a single task.  Null values get a null rank.  The rows
    are materialised first: ranks join back on the value itself, which must not
    be summed anew in another order."""
    valued = cut_lineage(df.withColumn("_v", value.cast("double")))
    counts = _bucketed(valued.filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), keys, buckets)
    above = Window.partitionBy(*keys, "_b").orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    higher = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(higher), F.lit(0))).drop("_n")
               if keys else _global_offsets(counts))
    ranks = inside.join(offsets, [*keys, "_b"]).select(
        *keys, "_v", (F.col("_above") + F.col("_offset") + 1).cast("long").alias(name))
    return valued.join(ranks, [*keys, "_v"], "left").drop("_v")


def _global_offsets(counts: DataFrame) -> DataFrame:
    """Offsets without a group: one row per value range, so one small window."""
    totals = counts.groupBy("_b").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")


def optimal_lag(correlogram: DataFrame, side: str = "all", max_lag: int | None = None,
                keys: tuple[str, ...] = ("candidate",)) -> DataFrame:
    """Lag with the largest absolute correlation, smallest lag on ties."""
    rows = correlogram.filter(F.col("correlation").isNotNull())
    if side == "positive":
        rows = rows.filter("lag > 0")
    elif side == "negative":
        rows = rows.filter("lag < 0")
    if max_lag is not None:
        rows = rows.filter(F.abs("lag") <= max_lag)
    best = F.max_by(F.struct("lag", "correlation"), F.struct(F.abs("correlation"), -F.col("lag")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.lag", "b.correlation")


def by_growth(summary: DataFrame, column: str) -> DataFrame:
    """Summary rows by falling growth, missing last."""
    return summary.orderBy(F.col(column).desc_nulls_last(), "series")


def groups_by_size(indicators: DataFrame) -> DataFrame:
    """Indicators with the sizes of their industry and type group, largest first."""
    by_type = indicators.groupBy("industry", "type").agg(F.count(F.lit(1)).alias("n_type"))
    by_industry = by_type.groupBy("industry").agg(F.sum("n_type").alias("n_industry"))
    sizes = by_type.join(by_industry, "industry")
    return indicators.select("name", "industry", "type").join(sizes, ["industry", "type"]).orderBy(
        F.col("n_industry").desc(), "industry", F.col("n_type").desc(), "type", "name")


def numeric_text_order(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows by the number inside possibly ``%``-suffixed text, missing last."""
    number = F.regexp_replace(F.col(column).cast("string"), "%", "").try_cast("double")
    return df.orderBy(number.asc_nulls_last() if ascending else number.desc_nulls_last(), *df.columns)


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered table, numbered from 1."""
    return ordered.offset((number - 1) * size).limit(size)


def problem_variables_first(report: DataFrame) -> DataFrame:
    """Non-stationary, then insufficient, then stationary variables."""
    priority = F.when(F.col("status") == "数据不足", 1).when(F.col("status") == "是", 2).otherwise(0)
    return report.withColumn("priority", priority).orderBy("priority", "series")


def problem_variables(report: DataFrame) -> DataFrame:
    return report.filter(F.col("status") != "是")

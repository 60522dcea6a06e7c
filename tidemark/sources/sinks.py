"""Prepared panel, variable mapping and processing log as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = ("variable", "state", "detail", "p_value", "stationary")


def _tests(results: DataFrame | None, like: DataFrame) -> DataFrame:
    if results is None:
        results = like.select("series").limit(0).select("series", F.lit(None).cast("double").alias("p_value"), F.lit("").alias("status"))
    return results.select(F.col("series").alias("variable"), F.format_string("%.4f", "p_value").alias("_p"), "status")


def processing_log(panel: DataFrame, removed: DataFrame | None = None, replaced: DataFrame | None = None,
                   config: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """One row per removal, value replacement and kept variable.

    ``removed(series, reason)``, ``replaced(series, rule, n)``,
    ``config(variable, ops)`` and ``results(series, p_value, status)``."""
    tests = _tests(results, panel)
    kept = panel.select(F.col("series").alias("variable")).distinct()
    if config is not None:
        ops = F.array_join(F.filter("ops", lambda o: o != "none"), " -> ")
        kept = kept.join(config.select("variable", F.nullif(ops, F.lit("")).alias("_ops")), "variable", "left")
    else:
        kept = kept.withColumn("_ops", F.lit(None).cast("string"))
    rows = kept.select("variable", F.lit("保留").alias("state"), F.coalesce("_ops", F.lit("不处理")).alias("detail"))
    if replaced is not None:
        rows = rows.unionByName(replaced.select(
            F.col("series").alias("variable"), F.lit("值替换").alias("state"),
            F.concat(F.lit("规则: "), "rule", F.lit(", 影响"), F.col("n").cast("string"), F.lit("行")).alias("detail")))
    tested = rows.join(tests, "variable", "left").select(
        "variable", "state", "detail", F.coalesce("_p", F.lit("-")).alias("p_value"), F.coalesce("status", F.lit("-")).alias("stationary"))
    if removed is None:
        return tested
    gone = removed.select(F.col("series").alias("variable"), F.lit("删除").alias("state"), F.col("reason").alias("detail"),
                          F.lit("-").alias("p_value"), F.lit("-").alias("stationary"))
    return gone.unionByName(tested)


def clear_non_stationary(dictionary: DataFrame, results: DataFrame) -> DataFrame:
    """Dictionary whose predictor mark is gone for tested, non-stationary variables."""
    tests = results.select(F.col("series").alias("name"), F.col("status").alias("_s"))
    keep = F.col("_s").isNull() | (F.col("_s") == "是")
    return dictionary.join(tests, "name", "left").withColumn("is_predictor", F.col("is_predictor") & keep).drop("_s")


def write_prepared(panel: DataFrame, log: DataFrame, mapping: DataFrame, path: str) -> None:
    """Panel by falling date, variable mapping and log, as Parquet folders."""
    panel.orderBy(F.col("d").desc(), "series").write.mode("overwrite").parquet(f"{path}/panel")
    mapping.write.mode("overwrite").parquet(f"{path}/mapping")
    log.write.mode("overwrite").parquet(f"{path}/log")

"""Logical tables derived from the given Parquet tables, in Spark and in SQL.

Money is summed in whole cents and divided by one constant, so both engines
start from identical doubles whatever their order of addition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 7919000.0

BASE_SQL = {
    # Daily totals per order priority: five dense series.
    "daily": """SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 7919000e0 AS v
        FROM orders GROUP BY 1, 2""",
    # Raw daily observations, several per date, with a source position.
    "ticks": """SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) / 791900e0 END AS v,
        o_orderkey AS src_pos, o_orderstatus AS source FROM orders""",
    # Sparse series per supplier; a day whose goods all came back is missing.
    "sparse": """SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS series, CAST(l_shipdate AS DATE) AS d,
        CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) END) AS DOUBLE)
          / 7919000e0 AS v
        FROM lineitem GROUP BY 1, 2""",
    # Monthly totals per order priority, month starts.
    "monthly": """SELECT series, CAST(date_trunc('month', d) AS DATE) AS d, sum(v) AS v FROM @daily GROUP BY 1, 2""",
    # Running total inside each year, as cumulative reports have it.
    "cumulative": """SELECT series, d, sum(v) OVER (PARTITION BY series, year(d) ORDER BY d) AS v FROM @monthly""",
    # Weekly panel by return flag and line status.
    "panel": """SELECT l_returnflag || l_linestatus AS series,
        CAST(l_shipdate AS DATE) + CAST((5 - isodow(CAST(l_shipdate AS DATE)) + 7) % 7 AS INTEGER) AS d,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 79190000e0 AS v
        FROM lineitem GROUP BY 1, 2""",
    # Monthly goods per supplier nation.
    "nations": """SELECT n_name AS indicator, CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 791900000e0 AS v
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2""",
    # Weights of the nations with their three grouping attributes, wide.
    "weights_wide": """SELECT n_name AS indicator, any_value(n_nationkey) AS pos,
        any_value(CASE WHEN n_regionkey <= 1 THEN '高' WHEN n_regionkey <= 3 THEN '低' END) AS export_dependence,
        any_value(CASE n_nationkey % 4 WHEN 0 THEN '上游' WHEN 1 THEN '中游' WHEN 2 THEN '下游' END) AS stream,
        any_value(r_name) AS sector,
        count(*) / 97e0 AS "权重_1996",
        CASE WHEN sum(CAST(round(s_acctbal * 100) AS BIGINT)) > 1000000
             THEN CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS DOUBLE) / 7919000e0 END AS "权重_1998",
        CAST(max(CAST(round(s_acctbal * 100) AS BIGINT)) AS DOUBLE) / 7919000e0 AS "权重_2000"
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1""",
    "weights": """SELECT indicator, pos, export_dependence, stream, sector, 1996 AS weight_year, "权重_1996" AS weight FROM @weights_wide
        UNION ALL SELECT indicator, pos, export_dependence, stream, sector, 1998, "权重_1998" FROM @weights_wide
        UNION ALL SELECT indicator, pos, export_dependence, stream, sector, 2000, "权重_2000" FROM @weights_wide""",
    # The weight in force for each nation and month.
    "weighted": """SELECT n.indicator, n.d, n.v, coalesce((SELECT arg_max(w.weight, w.weight_year) FROM @weights w
          WHERE w.indicator = n.indicator AND w.weight IS NOT NULL AND w.weight_year <= year(n.d)), 0.0) AS weight
        FROM @nations n""",
    # Indicator dictionary from parts; names repeat, the last part wins.
    "dictionary_raw": """SELECT p_partkey AS pos, p_name AS name, p_type AS type, p_brand AS industry,
        CASE p_size % 6 WHEN 0 THEN '日度' WHEN 1 THEN '周度' WHEN 2 THEN '旬度' WHEN 3 THEN '月度'
                        WHEN 4 THEN '季度' ELSE '年度' END AS freq_text,
        CASE WHEN p_size <= 20 THEN '%' ELSE '万吨' END AS unit,
        CASE p_size % 4 WHEN 0 THEN '流量' WHEN 1 THEN '率' WHEN 2 THEN '存量' ELSE '同比' END AS nature,
        CASE WHEN p_retailprice > 1000 THEN '是' ELSE '否' END AS predictor,
        CASE WHEN p_size = 50 THEN '是' END AS target, CAST(p_size AS VARCHAR) AS lag_text FROM part""",
    "dictionary": """SELECT name, lower(name) AS name_norm, type, industry,
        CASE freq_text WHEN '日度' THEN 'D' WHEN '周度' THEN 'W' WHEN '旬度' THEN 'K' WHEN '月度' THEN 'M'
                       WHEN '季度' THEN 'Q' ELSE 'Y' END AS freq, unit, nature,
        predictor = '是' AS is_predictor, coalesce(target = '是', false) AS is_target,
        CAST(lag_text AS INTEGER) AS publication_lag_days
        FROM @dictionary_raw QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY pos DESC) = 1""",
    # Weekly nowcast and monthly target per order status.
    "nowcast": """SELECT o_orderstatus AS model_id,
        CAST(o_orderdate AS DATE) + CAST((5 - isodow(CAST(o_orderdate AS DATE)) + 7) % 7 AS INTEGER) AS d,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 7919000e0 AS v
        FROM orders GROUP BY 1, 2""",
    "target": """SELECT o_orderstatus AS model_id, last_day(CAST(o_orderdate AS DATE)) AS d,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 7919000e0 AS v
        FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2""",
    # Weekly cells per model, variable and factor, the raw matter of model tables.
    "cells": """SELECT l_linestatus AS model_id, n_name AS variable,
        CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS factor,
        CAST(l_shipdate AS DATE) + CAST((5 - isodow(CAST(l_shipdate AS DATE)) + 7) % 7 AS INTEGER) AS d,
        sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc, sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price, count(*) AS n
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2, 3, 4""",
    "loadings": """SELECT model_id, variable, factor, CAST(sum(disc) AS DOUBLE) / sum(n) / 7e0 - 0.5 AS loading FROM @cells GROUP BY 1, 2, 3""",
    "states": """SELECT model_id, d, factor, CAST(sum(price) AS DOUBLE) / sum(n) / 7919000e0 AS state FROM @cells GROUP BY 1, 2, 3""",
    "gains": """SELECT model_id, d, factor, variable, CAST(sum(tax) AS DOUBLE) / sum(n) / 13e0 - 0.3 AS gain FROM @cells GROUP BY 1, 2, 3, 4""",
    "observed": """SELECT model_id, d, variable, CAST(sum(price) AS DOUBLE) / sum(n) / 7919000e0 AS observed FROM @cells GROUP BY 1, 2, 3""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def _friday(c: str):
    return F.next_day(F.date_sub(F.col(c).cast("date"), 1), "FRI")


def _total(cents, unit=UNIT):
    return F.sum(cents).cast("double") / F.lit(unit)


def daily(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("d")).agg(
        _total(_cents("o_totalprice")).alias("v"))


def ticks(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("d"),
        F.when(F.col("o_orderstatus") != "P", _cents("o_totalprice") / F.lit(UNIT / 10)).alias("v"),
        F.col("o_orderkey").alias("src_pos"), F.col("o_orderstatus").alias("source"))


def sparse(spark, sf_dir):
    """Partitioned by series from the first read on: a supplier has few lines a
    day, so that adding up before the exchange would hold them all and save little."""
    from tidemark.session import spread_rows
    lines = table(spark, sf_dir, "lineitem")
    cents = F.when(F.col("l_returnflag") != "R", _cents("l_extendedprice"))
    rows = lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("series"),
                        F.col("l_shipdate").cast("date").alias("d"), cents.alias("cents"))
    return spread_rows(rows, lines.count(), "series").groupBy("series", "d").agg(_total(F.col("cents")).alias("v"))


def monthly(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("series", F.trunc("d", "MM").alias("d")).agg(F.sum("v").alias("v"))


def cumulative(spark, sf_dir):
    from pyspark.sql import Window
    w = Window.partitionBy("series", F.year("d")).orderBy("d")
    return monthly(spark, sf_dir).withColumn("v", F.sum("v").over(w))


def panel(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("series"), _friday("l_shipdate").alias("d")).agg(
        _total(_cents("l_extendedprice"), UNIT * 10).alias("v"))


def _with_nation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    places = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))


def nations(spark, sf_dir):
    return _with_nation(spark, sf_dir).groupBy(
        F.col("n_name").alias("indicator"), F.trunc("l_shipdate", "MM").alias("d")).agg(
        _total(_cents("l_extendedprice"), UNIT * 100).alias("v"))


def weights_wide(spark, sf_dir):
    key = F.col("n_nationkey")
    cents = F.sum(_cents("s_acctbal"))
    return (table(spark, sf_dir, "supplier")
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == key)
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(F.col("n_name").alias("indicator")).agg(
                F.first(key).alias("pos"),
                F.first(F.when(F.col("n_regionkey") <= 1, "高").when(F.col("n_regionkey") <= 3, "低")).alias("export_dependence"),
                F.first(F.when(key % 4 == 0, "上游").when(key % 4 == 1, "中游").when(key % 4 == 2, "下游")).alias("stream"),
                F.first("r_name").alias("sector"),
                (F.count(F.lit(1)) / F.lit(97.0)).alias("权重_1996"),
                F.when(cents > 1000000, cents.cast("double") / UNIT).alias("权重_1998"),
                (F.max(_cents("s_acctbal")).cast("double") / UNIT).alias("权重_2000")))


def weights(spark, sf_dir):
    from tidemark.sources.scan import melt_weights
    return melt_weights(weights_wide(spark, sf_dir))


def dictionary_raw(spark, sf_dir):
    size = F.col("p_size")
    freq = F.lit("年度")
    for i, word in reversed(list(enumerate(["日度", "周度", "旬度", "月度", "季度"]))):
        freq = F.when(size % 6 == i, word).otherwise(freq)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
        F.col("p_brand").alias("industry"), freq.alias("freq_text"),
        F.when(size <= 20, "%").otherwise("万吨").alias("unit"),
        F.when(size % 4 == 0, "流量").when(size % 4 == 1, "率").when(size % 4 == 2, "存量").otherwise("同比").alias("nature"),
        F.when(F.col("p_retailprice") > 1000, "是").otherwise("否").alias("predictor"),
        F.when(size == 50, "是").alias("target"), size.cast("string").alias("lag_text"))


def dictionary(spark, sf_dir):
    from tidemark.sources.scan import indicator_dictionary
    d = indicator_dictionary(dictionary_raw(spark, sf_dir), "pos")
    return d.withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def _mean_by(spark, sf_dir, keep, stamp):
    cents = _cents("o_totalprice")
    return table(spark, sf_dir, "orders").filter(keep).groupBy(
        F.col("o_orderstatus").alias("model_id"), stamp.alias("d")).agg(
        (F.sum(cents).cast("double") / F.count(F.lit(1)) / UNIT).alias("v"))


def nowcast(spark, sf_dir):
    return _mean_by(spark, sf_dir, F.lit(True), _friday("o_orderdate"))


def target(spark, sf_dir):
    return _mean_by(spark, sf_dir, F.col("o_orderpriority") != "5-LOW", F.last_day("o_orderdate"))


def cells(spark, sf_dir):
    flag = F.col("l_returnflag")
    return _with_nation(spark, sf_dir).groupBy(
        F.col("l_linestatus").alias("model_id"), F.col("n_name").alias("variable"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("factor"), _friday("l_shipdate").alias("d")).agg(
        F.sum(_cents("l_discount")).alias("disc"), F.sum(_cents("l_tax")).alias("tax"),
        F.sum(_cents("l_extendedprice")).alias("price"), F.count(F.lit(1)).alias("n"))


def _ratio(num, scale, shift=0.0):
    return F.sum(num).cast("double") / F.sum("n") / F.lit(scale) - F.lit(shift)


def model_tables(spark, sf_dir):
    """``loadings, states, gains, observed`` from one stored table of cells, as
    a trained model's tables would be read back."""
    from tidemark.session import cut_lineage
    c = cut_lineage(cells(spark, sf_dir))
    return {
        "loadings": c.groupBy("model_id", "variable", "factor").agg(_ratio("disc", 7.0, 0.5).alias("loading")),
        "states": c.groupBy("model_id", "d", "factor").agg(_ratio("price", UNIT).alias("state")),
        "gains": c.groupBy("model_id", "d", "factor", "variable").agg(_ratio("tax", 13.0, 0.3).alias("gain")),
        "observed": c.groupBy("model_id", "d", "variable").agg(_ratio("price", UNIT).alias("observed"))}


def observed(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("model_id", "d", "variable").agg(_ratio("price", UNIT).alias("observed"))

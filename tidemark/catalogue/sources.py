"""A: scans, dictionaries, ranges, audits, sinks."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.functions import text
from tidemark.sources import audit, scan

MELT_SQL = """SELECT 'l_quantity' AS series, l_shipdate AS ts, l_quantity AS v FROM lineitem
    UNION ALL SELECT 'l_discount', l_shipdate, l_discount FROM lineitem
    UNION ALL SELECT 'l_tax', l_shipdate, l_tax FROM lineitem
    UNION ALL SELECT 'l_extendedprice', l_shipdate, l_extendedprice FROM lineitem"""


def _wide(spark, sf):
    return bases.table(spark, sf, "lineitem").select("l_shipdate", "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("scan_wide", "series:s d:d n:n v:f", f"""SELECT series, CAST(ts AS DATE) AS d, count(*) AS n,
    CAST(sum(CAST(round(v * 100) AS BIGINT)) AS DOUBLE) / 791.9 AS v FROM ({MELT_SQL}) GROUP BY 1, 2""")
def scan_wide(spark, sf):
    obs = scan.drop_empty(scan.to_observations(scan.melt(_wide(spark, sf))))
    return obs.groupBy("series", "d").agg(
        F.count("v").alias("n"), (F.sum(F.round(F.col("v") * 100).cast("bigint")).cast("double") / 791.9).alias("v"))


@query("scan_quality_gate", "series:s n_rows:n date_ratio:f value_ratio:f passed:b", """
    SELECT series, count(*) AS n_rows, avg(CASE WHEN d IS NOT NULL THEN 1.0 ELSE 0.0 END) AS date_ratio,
      avg(CASE WHEN d IS NOT NULL THEN CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS value_ratio,
      avg(CASE WHEN d IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5 AND
      coalesce(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END END), 0)
        >= CASE WHEN series = 'purchase' THEN 0.5 ELSE 0.3 END AS passed
    FROM (SELECT event_type AS series, CAST(ts AS DATE) AS d,
      TRY_CAST(replace(replace(CASE WHEN value < 15 THEN CAST(value AS VARCHAR) || '%' ELSE 'n/a' END, '%', ''), ',', '') AS DOUBLE) AS v
      FROM events) GROUP BY 1""")
def scan_quality_gate(spark, sf):
    cells = bases.table(spark, sf, "events").select(
        F.col("event_type").alias("series"), F.col("ts").cast("date").cast("string").alias("d_text"),
        F.when(F.col("value") < 15, F.concat(F.col("value").cast("string"), F.lit("%"))).otherwise("n/a").alias("v_text"))
    return scan.quality_gate(cells, target="purchase")


@query("scan_undefined_series", "series:s", """SELECT DISTINCT p_type || ' ' || p_brand AS series FROM part
    WHERE lower(p_type || ' ' || p_brand) NOT IN (SELECT lower(p_type || ' ' || p_brand) FROM part WHERE p_size > 45)""")
def scan_undefined_series(spark, sf):
    part = bases.table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("series"), "p_size")
    known = part.filter("p_size > 45").select(text.normalize_text(F.col("series")).alias("name_norm")).distinct()
    return scan.undefined_series(part, known)


@query("scan_first_source", "series:s source:s n:n", """SELECT series, source, count(*) AS n FROM @ticks t
    WHERE source = (SELECT arg_min(source, (src_pos, source)) FROM @ticks u WHERE u.series = t.series) GROUP BY 1, 2""")
def scan_first_source(spark, sf):
    return scan.first_source(bases.ticks(spark, sf)).groupBy("series", "source").agg(F.count(F.lit(1)).alias("n"))


@query("scan_route_frequency", "series:s freq:s d:d v:f", """
    SELECT p_name AS series, freq, CAST(l_shipdate AS DATE) AS d,
      arg_max(CAST(round(l_extendedprice * 100) AS BIGINT) / 7919e0, (l_orderkey, l_linenumber, l_suppkey)) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN @dictionary dd ON dd.name_norm = lower(p_name)
    GROUP BY 1, 2, 3""")
def scan_route_frequency(spark, sf):
    obs = bases.table(spark, sf, "lineitem").join(
        bases.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("series"), F.col("l_shipdate").cast("date").alias("d"),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint") / F.lit(7919.0)).alias("v"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("src_pos"))
    return scan.route_by_frequency(obs, bases.dictionary(spark, sf))


@query("indicator_dictionary",
       "name:s type:s industry:s freq:s unit:s nature:s is_predictor:b is_target:b publication_lag_days:n",
       "SELECT * FROM @dictionary")
def indicator_dictionary(spark, sf):
    return bases.dictionary(spark, sf)


@query("scan_monthly_macro", "series:s d:d v:f", """
    SELECT series, CAST(date_trunc('month', d) AS DATE) AS d,
      CASE WHEN NOT (series = '1-URGENT' AND month(min(d)) IN (1, 2)) THEN nullif(first(v ORDER BY src_pos), 0.0) END AS v
    FROM @ticks GROUP BY series, date_trunc('month', d)""")
def scan_monthly_macro(spark, sf):
    return scan.scan_monthly(bases.ticks(spark, sf), zero_to_null=True, blank_early_months_of="1-URGENT")


@query("scan_monthly_profit", "series:s d:d v:f", """SELECT series, CAST(date_trunc('month', d) AS DATE) AS d,
    first(v ORDER BY src_pos) AS v FROM @ticks GROUP BY series, date_trunc('month', d)""")
def scan_monthly_profit(spark, sf):
    return scan.scan_monthly(bases.ticks(spark, sf))


@query("scan_weights", "indicator:s weight_year:n weight:f stream:s", "SELECT * FROM @weights")
def scan_weights(spark, sf):
    return bases.weights(spark, sf)


@query("time_ranges", "source:s first_date:d last_date:d n_rows:n", """SELECT source, min(d) AS first_date,
    max(d) AS last_date, count(*) AS n_rows FROM @ticks GROUP BY ROLLUP(source)""")
def time_ranges(spark, sf):
    return scan.time_ranges(bases.ticks(spark, sf), "source")


@query("staged_view", "series:s d:d v:f", """SELECT series, d, v FROM @daily
    WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'""")
def staged_view(spark, sf):
    scan.stage(bases.daily(spark, sf), "staged_daily", ["series", "d", "v"], "1996-01-01", "1996-06-30")
    return spark.table("staged_daily")


@query("resolve_requested", "requested:s series:s", """
    WITH have AS (SELECT DISTINCT p_brand AS series FROM part),
    req AS (SELECT DISTINCT CASE WHEN p_size < 10 THEN upper(p_brand) WHEN p_size < 20 THEN p_brand ELSE p_brand || 'x' END AS requested FROM part)
    SELECT requested, coalesce(e.series, f.series) AS series FROM req
    LEFT JOIN have e ON e.series = requested
    LEFT JOIN (SELECT lower(series) AS k, min(series) AS series FROM have GROUP BY 1) f ON f.k = lower(requested)""")
def resolve_requested(spark, sf):
    part = bases.table(spark, sf, "part")
    size, brand = F.col("p_size"), F.col("p_brand")
    wanted = part.select(F.when(size < 10, F.upper(brand)).when(size < 20, brand)
                         .otherwise(F.concat(brand, F.lit("x"))).alias("requested")).distinct()
    return scan.resolve_requested(wanted, part.select(brand.alias("series")).distinct())


AUDIT_COLUMNS = ("series:s n_rows:n first_date:d last_date:d missing_pct:f too_sparse:b n_duplicates:n "
                 "irregular:b frequency:s")
AUDIT_SQL = """
    WITH g AS (SELECT series, d, v, date_diff('day', lag(d) OVER (PARTITION BY series ORDER BY d, src_pos), d) AS gap FROM @ticks),
    m AS (SELECT series, arg_min(gap, (-k, gap)) AS mode_gap FROM (SELECT series, gap, count(*) AS k FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    a AS (SELECT series, count(*) AS n_rows, min(d) AS first_date, max(d) AS last_date,
        (count(*) - count(v)) * 100.0 / count(*) AS missing_pct, count(*) - count(DISTINCT d) AS n_duplicates,
        coalesce(stddev_samp(gap) > avg(gap) * 0.1, false) AS irregular FROM g GROUP BY 1)
    SELECT a.*, missing_pct > 50 AS too_sparse, CASE WHEN mode_gap IS NULL THEN 'unknown' WHEN mode_gap = 1 THEN 'daily' WHEN mode_gap = 7 THEN 'weekly'
        WHEN mode_gap BETWEEN 28 AND 31 THEN 'monthly' WHEN mode_gap BETWEEN 90 AND 92 THEN 'quarterly'
        WHEN mode_gap BETWEEN 365 AND 366 THEN 'yearly' ELSE 'custom (' || mode_gap || ' days)' END AS frequency
    FROM a LEFT JOIN m USING (series)"""


@query("time_series_audit", AUDIT_COLUMNS, AUDIT_SQL)
def time_series_audit(spark, sf):
    return audit.time_series_audit(bases.ticks(spark, sf))


@query("time_series_audit_sparse", AUDIT_COLUMNS, AUDIT_SQL.replace("@ticks", "(SELECT *, 0 AS src_pos FROM @sparse)"))
def time_series_audit_sparse(spark, sf):
    return audit.time_series_audit(bases.sparse(spark, sf))


@query("series_gate", "series:s n_total:n n_valid:n status:s", """
    SELECT series, count(*) AS n_total, count(v) AS n_valid, CASE WHEN count(v) < 400 THEN 'insufficient_data'
      WHEN count(v) > 1 AND min(v) = max(v) THEN 'no_variance' ELSE 'valid' END AS status FROM @sparse GROUP BY 1""")
def series_gate(spark, sf):
    return audit.series_gate(bases.sparse(spark, sf), min_samples=400)


@query("pair_gate", "series:s n_common:n status:s", """
    WITH t AS (SELECT d, v AS tv FROM @sparse WHERE series = 'S1' AND v IS NOT NULL)
    SELECT s.series, count(tv) AS n_common, CASE WHEN count(tv) = 0 THEN 'no_common_data' WHEN count(tv) < 100 THEN 'insufficient_data'
      WHEN count(tv) > 1 AND (min(CASE WHEN tv IS NOT NULL THEN v END) = max(CASE WHEN tv IS NOT NULL THEN v END) OR min(tv) = max(tv))
      THEN 'no_variance' ELSE 'valid' END AS status
    FROM @sparse s LEFT JOIN t USING (d) WHERE s.series <> 'S1' AND s.v IS NOT NULL GROUP BY 1""")
def pair_gate(spark, sf):
    return audit.pair_gate(bases.sparse(spark, sf), "S1", min_samples=100)


@query("weight_coverage", "indicator:s status:s", """
    SELECT coalesce(a.i, b.i) AS indicator, CASE WHEN b.i IS NULL THEN 'without_weight' WHEN a.i IS NULL THEN 'without_data' ELSE 'matched' END AS status
    FROM (SELECT DISTINCT n_name AS i FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT r_name FROM region) a
    FULL JOIN (SELECT DISTINCT indicator AS i FROM @weights) b ON a.i = b.i""")
def weight_coverage(spark, sf):
    nations = bases.table(spark, sf, "customer").join(bases.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # Regions are data without a weight of their own.
    data = nations.select(F.col("n_name").alias("indicator")).unionByName(bases.table(spark, sf, "region").select(F.col("r_name").alias("indicator")))
    return audit.weight_coverage(data, bases.weights(spark, sf))


@query("industry_conflicts", "variable:s sheet_industry:s dictionary_industry:s problem:s", """
    WITH s AS (SELECT lower(p_name) AS variable, p_brand AS sheet_industry FROM part)
    SELECT s.variable, sheet_industry, dd.industry AS dictionary_industry,
      CASE WHEN dd.industry IS NULL THEN 'undefined' ELSE 'conflict' END AS problem
    FROM s LEFT JOIN (SELECT * FROM @dictionary WHERE freq <> 'D') dd ON dd.name_norm = s.variable
    WHERE dd.industry IS NULL OR dd.industry <> sheet_industry""")
def industry_conflicts(spark, sf):
    known = bases.dictionary(spark, sf).filter("freq <> 'D'").select(F.col("name").alias("variable"), "industry")
    sheets = bases.table(spark, sf, "part").select(F.col("p_name").alias("variable"), F.col("p_brand").alias("industry"))
    return audit.industry_conflicts(known, sheets)


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    f"(count(*) - count({c})) * 100.0 / count(*) AS null_pct FROM t"
    for c, k in (("series", "text"), ("d", "datetime"), ("v", "numeric"), ("src_pos", "numeric"), ("source", "text")))


@query("data_quality_profile", "column_name:s kind:s n_rows:n n_null:n null_pct:f",
       f"WITH t AS (SELECT * FROM @ticks) {PROFILE_SQL}")
def data_quality_profile(spark, sf):
    return audit.profile(bases.ticks(spark, sf))

"""E, D9, D10, D23: differences, gaps, trends, trailing and running aggregates."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.operators import align, window
from tidemark.catalogue.alignment import SPINE, WEEKLY, bounds

W = "WINDOW w AS (PARTITION BY series ORDER BY d)"


@query("diff_lag", "series:s d:d v:f", f"SELECT series, d, v - lag(v, 12) OVER w AS v FROM @monthly {W}")
def diff_lag(spark, sf):
    return window.diff_lag(bases.monthly(spark, sf), 12)


@query("diff_order", "series:s d:d v:f", f"""SELECT series, d, v FROM (SELECT series, d, ln(v) - 2 * lag(ln(v)) OVER w + lag(ln(v), 2) OVER w AS v,
    row_number() OVER w AS p FROM @monthly {W}) WHERE p > 2""")
def diff_order(spark, sf):
    return window.diff_order(bases.monthly(spark, sf), 2, use_log=True)


@query("log_values", "series:s d:d v:f", """SELECT series, d, CASE WHEN lo > 0 THEN ln(v) WHEN lo = 0 THEN ln(1 + v) END AS v
    FROM (SELECT series, d, v, min(v) OVER (PARTITION BY series) AS lo FROM
      (SELECT series, d, CASE WHEN series < '2' THEN v WHEN series < '4' THEN v - min(v) OVER (PARTITION BY series) ELSE v - 1 END AS v FROM @daily))""")
def log_values(spark, sf):
    return window.log_values(_shifted(spark, sf))


@query("log_errors", "series:s lowest:f", "SELECT series, min(v) - 1 AS lowest FROM @daily WHERE series >= '4' GROUP BY 1 HAVING min(v) < 1")
def log_errors(spark, sf):
    return window.log_errors(_shifted(spark, sf))


def _shifted(spark, sf):
    s = F.col("series")
    return bases.daily(spark, sf).withColumn("v", F.when(s < "2", F.col("v")).when(
        s < "4", F.col("v") - F.min("v").over(window.whole())).otherwise(F.col("v") - 1))


CHAIN = f"""WITH a AS (SELECT series, d, v AS original, CASE WHEN series < '3' THEN ln(v) ELSE v END AS x FROM @monthly),
    b AS (SELECT series, d, original, CASE WHEN series < '3' THEN x - lag(x, 12) OVER w WHEN series < '5' THEN x - lag(x) OVER w ELSE x END AS v FROM a {W})"""


def _config(spark, sf):
    s = F.col("series")
    ops = F.when(s < "3", F.array(F.lit("log"), F.lit("diff_yoy"))).when(
        s < "5", F.array(F.lit("none"), F.lit("diff_1"))).otherwise(F.array(F.lit("none")))
    return bases.monthly(spark, sf).select("series").distinct().select(
        s.alias("variable"), F.lit("missing").alias("zero_method"), ops.alias("ops"))


@query("transform_chain", "series:s d:d v:f original:f", CHAIN + "SELECT * FROM b")
def transform_chain(spark, sf):
    return window.transform(bases.monthly(spark, sf), _config(spark, sf), "MS")


def _facts(c, t):
    return (f"avg({c}) AS mean_{t}, stddev_samp({c}) AS std_{t}, min({c}) AS min_{t}, max({c}) AS max_{t}, "
            f"count(*) - count({c}) AS nulls_{t}")


@query("transform_summary", "series:s " + " ".join(f"mean_{t}:f std_{t}:f min_{t}:f max_{t}:f nulls_{t}:n" for t in ("before", "after")),
       CHAIN + f"SELECT series, {_facts('original', 'before')}, {_facts('v', 'after')} FROM b GROUP BY 1")
def transform_summary(spark, sf):
    return window.transform_summary(window.transform(bases.monthly(spark, sf), _config(spark, sf), "MS"))


@query("operation_counts", "op:s n:n", """SELECT op, count(*) AS n FROM (SELECT DISTINCT series FROM @monthly), (VALUES ('log', '', '3'), ('diff_yoy', '', '3'), ('diff_1', '3', '5')) AS o(op, lo, hi)
    WHERE series >= lo AND series < hi GROUP BY 1""")
def operation_counts(spark, sf):
    return window.operation_counts(_config(spark, sf))


@query("cumulative_to_current", "series:s d:d v:f", f"SELECT series, d, coalesce(v - lag(v) OVER w, CASE WHEN row_number() OVER w = 1 THEN v END) AS v FROM @cumulative {W}")
def cumulative_to_current(spark, sf):
    return window.cumulative_to_current(bases.cumulative(spark, sf))


GAPS = WEEKLY.format(src="SELECT * FROM @sparse") + """,
    isl AS (SELECT series, d, v, count(v) OVER (PARTITION BY series ORDER BY d) AS i, count(v) OVER (PARTITION BY series) AS c FROM aligned),
    k AS (SELECT series, i, any_value(c) AS c, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS k, min(d) FILTER (v IS NULL) AS lo, max(d) FILTER (v IS NULL) AS hi FROM isl GROUP BY 1, 2),
    best AS (SELECT series, k, lo, hi FROM k WHERE (i > 0 OR c = 0) AND k > 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY k DESC, lo) = 1),
    tot AS (SELECT series, count(*) AS total, count(*) - count(v) AS missing FROM aligned GROUP BY 1)"""


@query("gap_report", "series:s longest_gap:n gap_start:d gap_end:d total:n missing:n missing_pct:f", GAPS + """
    SELECT series, coalesce(k, 0) AS longest_gap, lo AS gap_start, hi AS gap_end, total, missing, missing * 100.0 / total AS missing_pct
    FROM tot LEFT JOIN best USING (series)""")
def gap_report(spark, sf):
    return window.gap_report(align.align_weekly(bases.sparse(spark, sf), *bounds(spark, sf)))


@query("drop_gappy_series", "series:s n:n", GAPS + """SELECT series, count(v) AS n FROM aligned
    WHERE series NOT IN (SELECT series FROM best WHERE k >= 4) GROUP BY 1""")
def drop_gappy_series(spark, sf):
    dense = align.align_weekly(bases.sparse(spark, sf), *bounds(spark, sf))
    return window.drop_gappy(dense, 4).groupBy("series").agg(F.count("v").alias("n"))


@query("trailing_means", "series:s d:d mean_7:f mean_30:f", """SELECT series, d,
    avg(v) OVER (PARTITION BY series ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS mean_7,
    avg(v) OVER (PARTITION BY series ORDER BY d RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS mean_30 FROM @daily""")
def trailing_means(spark, sf):
    return window.trailing_means(bases.daily(spark, sf))


@query("detrend", "series:s d:d v:f trend:f", """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d) - 1 AS p FROM @sparse),
    r AS (SELECT series, regr_intercept(v, p) AS a, regr_slope(v, p) AS b, count(v) AS k FROM n GROUP BY 1)
    SELECT series, d, CASE WHEN k >= 3 THEN v - (a + b * p) END AS v, CASE WHEN k >= 3 THEN a + b * p END AS trend FROM n JOIN r USING (series)""")
def detrend(spark, sf):
    return window.detrend(bases.sparse(spark, sf))


@query("publication_shift", "series:s d:d v:f", """
    SELECT series, d + coalesce(CAST(k.lag AS INTEGER), 0) AS d, v FROM @monthly LEFT JOIN
      (SELECT o_orderpriority AS series, CAST(count(*) % 45 AS INTEGER) AS lag FROM orders WHERE o_orderpriority < '4' GROUP BY 1) k USING (series)""")
def publication_shift(spark, sf):
    lags = bases.table(spark, sf, "orders").filter("o_orderpriority < '4'").groupBy(
        F.lower("o_orderpriority").alias("name_norm")).agg((F.count(F.lit(1)) % 45).cast("int").alias("publication_lag_days"))
    return window.shift_publication(bases.monthly(spark, sf), lags)


@query("moving_average", "series:s d:d v:f moving:f", """SELECT series, d, v, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS moving
    FROM @sparse WINDOW w AS (PARTITION BY series ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def moving_average(spark, sf):
    return window.moving_average(bases.sparse(spark, sf), 7)


@query("weekly_year_overlay", "series:s week:n current:f previous:f", """
    SELECT s.series, k.week, arg_max(v, d) FILTER (year(d) = 1999 AND v IS NOT NULL) AS current, arg_max(v, d) FILTER (year(d) = 1998 AND v IS NOT NULL) AS previous
    FROM (SELECT DISTINCT series FROM @sparse) s CROSS JOIN (SELECT unnest(range(1, 54)) AS week) k
    LEFT JOIN @sparse o ON o.series = s.series AND weekofyear(o.d) = k.week GROUP BY 1, 2""")
def weekly_year_overlay(spark, sf):
    return window.weekly_year_overlay(bases.sparse(spark, sf), 1999)


@query("standardize_zscore", "series:s d:d v:f", """SELECT series, d, CASE WHEN min(v) OVER w = max(v) OVER w OR max(v) OVER w IS NULL THEN v
    ELSE (v - avg(v) OVER w) / stddev_samp(v) OVER w END AS v FROM @sparse WINDOW w AS (PARTITION BY series)""")
def standardize_zscore(spark, sf):
    return window.standardize(bases.sparse(spark, sf))


@query("standardize_minmax", "series:s d:d v:f", """SELECT series, d, CASE WHEN min(v) OVER w = max(v) OVER w OR max(v) OVER w IS NULL THEN v
    ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS v FROM @sparse WINDOW w AS (PARTITION BY series)""")
def standardize_minmax(spark, sf):
    return window.standardize(bases.sparse(spark, sf), "minmax")


SCALER = """WITH s AS (SELECT series, avg(v) AS mu, coalesce(nullif(stddev_samp(v), 0), 1.0) AS sigma FROM @sparse WHERE d <= DATE '1998-12-31' GROUP BY 1)"""


@query("scaler_transform", "series:s d:d v:f", SCALER + "SELECT series, d, coalesce((v - mu) / sigma, 0.0) AS v FROM @sparse JOIN s USING (series)")
def scaler_transform(spark, sf):
    obs = bases.sparse(spark, sf)
    return window.apply_scaler(obs, window.fit_scaler(obs, "1998-12-31"))


@query("scaler_round_trip", "series:s d:d v:f", "SELECT series, d, v FROM @sparse")
def scaler_round_trip(spark, sf):
    obs = bases.sparse(spark, sf)
    scaler = window.fit_scaler(obs, "1998-12-31")
    return window.unscale(window.apply_scaler(obs, scaler, fill=None), scaler)


@query("scaler_centre", "series:s d:d v:f", SCALER + "SELECT series, d, v - mu AS v FROM @sparse JOIN s USING (series)")
def scaler_centre(spark, sf):
    obs = bases.sparse(spark, sf)
    return window.centre(obs, window.fit_scaler(obs, "1998-12-31"))

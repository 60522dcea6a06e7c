"""Lagged correlation, divergence, warping, unit roots."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.catalogue.windows import _config
from tidemark.operators import align, lagged, rank, stationarity, warping

CORR = """WITH f AS (SELECT d, row_number() OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM @sparse)),
    x AS (SELECT p, v FROM @sparse JOIN f USING (d) WHERE series = 'S1'), y AS (SELECT series, p, v FROM @sparse JOIN f USING (d) WHERE series <> 'S1'),
    l AS (SELECT unnest(range(-6, 7)) AS lag),
    c AS (SELECT y.series AS candidate, l.lag, count(*) AS n, CASE WHEN min(x.v) < max(x.v) AND min(y.v) < max(y.v) THEN corr(x.v, y.v) END AS correlation
      FROM y CROSS JOIN l JOIN x ON x.p = y.p + l.lag WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT s.series AS candidate, l.lag, c.correlation FROM (SELECT DISTINCT series FROM y) s CROSS JOIN l LEFT JOIN c ON c.candidate = s.series AND c.lag = l.lag)"""


@query("lagged_correlation", "candidate:s lag:n correlation:f", CORR + "SELECT * FROM r")
def lagged_correlation(spark, sf):
    return lagged.lagged_correlation(bases.sparse(spark, sf), "S1", 6)


@query("optimal_lag", "candidate:s lag:n correlation:f", CORR + """SELECT candidate, arg_max(lag, (abs(correlation), -lag)) AS lag, arg_max(correlation, (abs(correlation), -lag)) AS correlation
    FROM r WHERE correlation IS NOT NULL GROUP BY 1""")
def optimal_lag(spark, sf):
    return rank.optimal_lag(lagged.lagged_correlation(bases.sparse(spark, sf), "S1", 6))


@query("optimal_positive_lag", "candidate:s lag:n correlation:f", CORR + """SELECT candidate, arg_max(lag, (abs(correlation), -lag)) AS lag, arg_max(correlation, (abs(correlation), -lag)) AS correlation
    FROM r WHERE correlation IS NOT NULL AND lag BETWEEN 1 AND 4 GROUP BY 1""")
def optimal_positive_lag(spark, sf):
    return rank.optimal_lag(lagged.lagged_correlation(bases.sparse(spark, sf), "S1", 6), "positive", 4)


def _kl_sql(src, target, lags, scaled, minimum):
    z = "(v - avg(v) OVER (PARTITION BY series)) / stddev_samp(v) OVER (PARTITION BY series)" if scaled else "v"
    return f"""WITH z AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY d) AS p, count(*) OVER (PARTITION BY series) AS n, {z} AS v FROM {src} WHERE v IS NOT NULL),
    c AS (SELECT DISTINCT y.series AS candidate, least(y.n, x.n) AS n FROM z y, z x WHERE x.series = '{target}' AND y.series <> '{target}'),
    k AS (SELECT candidate, lag, n, n - abs(lag) AS m FROM c CROSS JOIN (SELECT unnest(range(-{lags}, {lags} + 1)) AS lag)),
    a AS (SELECT candidate, lag, m, k.n, z.v FROM k JOIN z ON z.series = '{target}' WHERE p > greatest(lag, 0) AND p <= k.n + least(lag, 0)),
    b AS (SELECT candidate, lag, m, k.n, z.v FROM k JOIN z ON z.series = candidate WHERE p > greatest(-lag, 0) AND p <= k.n - greatest(lag, 0)),
    s AS (SELECT candidate, lag, any_value(m) AS m, min(v) AS lo, max(v) AS hi, CAST(greatest(2, ceil(least(sqrt(any_value(m)), 10 * log10(any_value(m))))) AS INTEGER) AS bins
      FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2),
    h AS (SELECT candidate, lag, bin, sum(fa) AS ca, sum(fb) AS cb FROM (
      SELECT candidate, lag, least(CAST(floor((v - lo) / ((hi - lo) / bins)) AS INTEGER), bins - 1) AS bin, fa, fb FROM
        (SELECT candidate, lag, v, 1 AS fa, 0 AS fb FROM a UNION ALL SELECT candidate, lag, v, 0, 1 FROM b) JOIN s USING (candidate, lag)) GROUP BY 1, 2, 3),
    g AS (SELECT s.candidate, s.lag, s.m, bins, coalesce(ca, 0) / m + 1e-9 AS pa, coalesce(cb, 0) / m + 1e-9 AS pb
      FROM (SELECT *, unnest(range(0, bins)) AS bin FROM s) s LEFT JOIN h ON h.candidate = s.candidate AND h.lag = s.lag AND h.bin = s.bin),
    kl AS (SELECT candidate, lag, any_value(m) AS m, greatest(0, sum(pa / (1 + bins * 1e-9) * (ln(pa) - ln(pb)))) AS kl FROM g GROUP BY 1, 2),
    out AS (SELECT k.candidate, k.lag, CASE WHEN k.n >= {minimum} AND k.m >= 10 THEN kl.kl END AS kl FROM k LEFT JOIN kl ON kl.candidate = k.candidate AND kl.lag = k.lag)"""


@query("divergence", "candidate:s kl:f status:s", _kl_sql("@panel", "AF", 0, False, 10) + "SELECT candidate, kl, 'ok' AS status FROM out")
def divergence(spark, sf):
    return lagged.divergence(bases.panel(spark, sf), "AF")


@query("lagged_divergence", "candidate:s lag:n kl:f", _kl_sql("@sparse", "S1", 6, True, 16) + "SELECT * FROM out")
def lagged_divergence(spark, sf):
    return lagged.lagged_divergence(bases.sparse(spark, sf), "S1", 6)


@query("lead_lag", "candidate:s lag:n kl:f", _kl_sql("@daily", "1-URGENT", 12, True, 22) + """
    SELECT candidate, arg_min(lag, (kl, lag)) AS lag, min(kl) AS kl FROM out WHERE abs(lag) <= 5 AND kl IS NOT NULL GROUP BY 1""")
def lead_lag(spark, sf):
    return lagged.lead_lag(bases.daily(spark, sf), "1-URGENT")


WARP = """WITH RECURSIVE m AS (SELECT series, d, v FROM @monthly),
    pr AS (SELECT c.series AS candidate, list((t.v - t.mu) / t.sd ORDER BY c.d) AS a, list((c.v - c.mu) / c.sd ORDER BY c.d) AS b, count(*) AS n FROM
      (SELECT *, avg(v) OVER w AS mu, stddev_samp(v) OVER w AS sd FROM m WHERE d IN (SELECT d FROM m WHERE series = '1-URGENT') WINDOW w AS (PARTITION BY series)) c
      JOIN (SELECT y.series, x.d, x.v, avg(x.v) OVER w AS mu, stddev_samp(x.v) OVER w AS sd FROM m x JOIN m y ON x.d = y.d WHERE x.series = '1-URGENT' AND y.series <> '1-URGENT'
        WINDOW w AS (PARTITION BY y.series)) t ON t.series = c.series AND t.d = c.d GROUP BY 1),
    dp(candidate, a, b, n, k, p2, p1) AS (
      SELECT candidate, a, b, n, 0, list_transform(range(0, n + 1), lambda x: CAST('inf' AS DOUBLE)),
        list_transform(range(0, n + 1), lambda x: CASE WHEN x = 1 THEN (a[1] - b[1]) * (a[1] - b[1]) ELSE CAST('inf' AS DOUBLE) END) FROM pr
      UNION ALL
      SELECT candidate, a, b, n, k + 1, p1, list_transform(range(0, n + 1), lambda x: CASE WHEN x = 0 OR k + 1 - (x - 1) < 0 OR k + 1 - (x - 1) > n - 1 {band} THEN CAST('inf' AS DOUBLE)
        ELSE (a[x] - b[k + 1 - (x - 1) + 1]) * (a[x] - b[k + 1 - (x - 1) + 1]) + least(p2[x], p1[x], p1[x + 1]) END) FROM dp WHERE k < 2 * n - 2)
    SELECT candidate, n, sqrt(p1[n + 1]) AS distance, CAST(NULL AS VARCHAR) AS reason FROM dp WHERE k = 2 * n - 2"""


@query("warp_strict", "candidate:s n:n distance:f reason:s", WARP.format(band=""))
def warp_strict(spark, sf):
    return warping.warp_candidates(bases.monthly(spark, sf), "1-URGENT")


@query("warp_radius", "candidate:s n:n distance:f reason:s", WARP.format(band="OR abs(k + 1 - 2 * (x - 1)) > 4"))
def warp_radius(spark, sf):
    return warping.warp_candidates(bases.monthly(spark, sf), "1-URGENT", radius=5)


@query("warp_loose", "candidate:s n:n distance:f reason:s")
def warp_loose(spark, sf):
    weekly = align.daily_to_weekly(bases.sparse(spark, sf)).filter(F.col("v").isNotNull())
    return warping.warp_candidates(weekly, "S1", strict=False)


@query("warp_ranking", "candidate:s distance:f path_length:n normalized:f")
def warp_ranking(spark, sf):
    m = bases.monthly(spark, sf)
    return warping.rank_by_distance(warping.warp_candidates(m, "1-URGENT"), warping.warp_paths(m, "1-URGENT"))


@query("warp_paths", "candidate:s step:n target_pos:n candidate_pos:n")
def warp_paths(spark, sf):
    return warping.warp_paths(bases.monthly(spark, sf), "1-URGENT", radius=10)


@query("unit_root_tests", "series:s n_valid:n p_value:f status:s formatted:s")
def unit_root_tests(spark, sf):
    return stationarity.formatted_status(stationarity.test_stationarity(bases.sparse(spark, sf)))


@query("difference_until_stationary", "series:s original_p:f original_status:s method:s processed_p:f final_status:s")
def difference_until_stationary(spark, sf):
    return stationarity.difference_until_stationary(bases.cumulative(spark, sf), "log_diff")


@query("processed_series", "series:s d:d v:f")
def processed_series(spark, sf):
    obs = bases.cumulative(spark, sf)
    return stationarity.processed_series(obs, stationarity.difference_until_stationary(obs, "diff"), "diff")


@query("recommend_differencing", "series:s label:s step:s season:s recommended:s")
def recommend_differencing(spark, sf):
    return stationarity.recommend_differencing(bases.cumulative(spark, sf))


@query("ensure_stationary", "series:s status:s original_p:f diff_p:f")
def ensure_stationary(spark, sf):
    return stationarity.ensure_stationary(bases.cumulative(spark, sf), skip=("5-LOW",))


@query("replay_stationarity_rules", "series:s d:d v:f", """SELECT series, d, CASE WHEN series < '2' THEN v WHEN series < '4' THEN v - lag(v) OVER w ELSE ln(v) - lag(ln(v)) OVER w END AS v
    FROM @monthly WINDOW w AS (PARTITION BY series ORDER BY d)""")
def replay_stationarity_rules(spark, sf):
    m = bases.monthly(spark, sf)
    s = F.col("series")
    rules = m.select(s).distinct().select(s, F.when(s < "2", "level").when(s < "4", "diff").otherwise("log_diff_still_nonstat").alias("status"))
    return stationarity.apply_rules(m, rules)


@query("transform_and_test", "series:s n_valid:n p_value:f status:s processing:s priority:n")
def transform_and_test(spark, sf):
    return stationarity.transform_and_test(bases.monthly(spark, sf), _config(spark, sf), "MS")


@query("stationarity_counts", "stationary:n insufficient:n non_stationary:n")
def stationarity_counts(spark, sf):
    return stationarity.status_counts(stationarity.test_stationarity(bases.sparse(spark, sf)))

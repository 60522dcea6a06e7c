"""Attribution of revisions."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.operators import news, window
from tidemark.session import cut_lineage

TARGET = "NATION_0"
REL = f"""pr AS (SELECT l.model_id, l.variable, s.d, sum(loading * state) AS expected FROM @loadings l JOIN @states s ON s.model_id = l.model_id AND s.factor = l.factor GROUP BY 1, 2, 3),
    rel AS (SELECT o.model_id, CAST(date_trunc('month', o.d) AS DATE) AS month, o.d AS ts, o.variable, observed, expected,
      CASE WHEN observed = expected THEN 0.01 ELSE abs(observed - expected) * 0.1 END AS measurement_error
      FROM @observed o ASOF JOIN pr ON pr.model_id = o.model_id AND pr.variable = o.variable AND o.d >= pr.d WHERE o.variable <> '{TARGET}')"""
IMP = REL + f""",
    tl AS (SELECT l.model_id, factor, loading, sd FROM @loadings l JOIN (SELECT model_id, stddev_samp(observed) AS sd FROM @observed WHERE variable = '{TARGET}' GROUP BY 1) USING (model_id) WHERE variable = '{TARGET}'),
    gk AS (SELECT g.model_id, g.variable, g.d, sum(gain * loading) AS dot, sqrt(sum(gain * gain)) AS norm, any_value(sd) AS sd FROM @gains g JOIN tl ON tl.model_id = g.model_id AND tl.factor = g.factor GROUP BY 1, 2, 3),
    imp AS (SELECT rel.*, dot * (observed - expected) * sd AS impact, norm AS gain_norm FROM rel ASOF JOIN gk ON gk.model_id = rel.model_id AND gk.variable = rel.variable AND rel.ts >= gk.d),
    con AS (SELECT *, coalesce(abs(impact) / nullif(sum(abs(impact)) OVER (PARTITION BY model_id, month), 0) * 100, 0) AS contribution_pct, impact > 0 AS is_positive FROM imp)"""
NORM = IMP + """,
    ch AS (SELECT model_id, CAST(date_trunc('month', d) AS DATE) AS month, arg_min(v, d) AS first_nowcast, arg_max(v, d) AS last_nowcast, count(v) AS k FROM @nowcast GROUP BY 1, 2),
    inf AS (SELECT c.*, first_nowcast, last_nowcast, last_nowcast - first_nowcast AS actual_change, CASE WHEN coalesce(k, 0) < 2 THEN 'too_few_nowcasts' WHEN abs(raw_total) < 1e-10 THEN 'impacts_cancel'
        WHEN abs(last_nowcast - first_nowcast) < 1e-10 THEN 'no_change' END AS problem
      FROM (SELECT model_id, month, sum(impact) AS raw_total FROM con GROUP BY 1, 2) c LEFT JOIN ch USING (model_id, month)),
    nrm AS (SELECT con.model_id, con.month, ts, variable, observed, impact * actual_change / raw_total AS impact, contribution_pct, impact * actual_change / raw_total > 0 AS is_positive
      FROM con JOIN inf USING (model_id, month) WHERE problem IS NULL)"""
IND = NORM + """, nat AS (SELECT n_name AS variable, r_name AS industry FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 4),
    ni AS (SELECT nrm.*, coalesce(industry, 'Other') AS industry FROM nrm LEFT JOIN nat USING (variable)),
    it AS (SELECT model_id, month, industry, sum(impact) AS impact, count(*) AS n, coalesce(sum(impact) FILTER (impact > 0), 0) AS positive, coalesce(sum(impact) FILTER (impact < 0), 0) AS negative,
      abs(sum(impact)) / sum(sum(abs(impact))) OVER (PARTITION BY model_id, month) * 100 AS contribution_pct FROM ni GROUP BY 1, 2, 3)"""


def _rel(m, month=None):
    return news.releases(m["observed"], m["loadings"], m["states"], TARGET, month)


def _target_loading(m):
    sd = m["observed"].filter(F.col("variable") == TARGET).groupBy("model_id").agg(F.stddev_samp("observed").alias("target_std"))
    return m["loadings"].filter(F.col("variable") == TARGET).join(sd, "model_id")


def _imp(spark, sf):
    m = bases.model_tables(spark, sf)
    return cut_lineage(news.impacts(_rel(m), m["gains"], _target_loading(m)))


def _con(spark, sf):
    return news.contributions(_imp(spark, sf))


def _norm(spark, sf):
    return news.normalize(_con(spark, sf), bases.nowcast(spark, sf))


def _ind(spark, sf):
    place = bases.table(spark, sf, "nation").join(bases.table(spark, sf, "region").filter("r_regionkey < 4"), F.col("n_regionkey") == F.col("r_regionkey"))
    return news.with_industry(_norm(spark, sf)[0], place.select(F.col("n_name").alias("variable"), F.col("r_name").alias("industry")))


@query("prior_predictions", "model_id:s variable:s d:d expected:f", f"WITH {REL} SELECT * FROM pr")
def prior_predictions(spark, sf):
    m = bases.model_tables(spark, sf)
    return news.prior_predictions(m["loadings"], m["states"])


@query("releases", "model_id:s month:d ts:d variable:s observed:f expected:f measurement_error:f", f"WITH {REL} SELECT * FROM rel")
def releases(spark, sf):
    return _rel(bases.model_tables(spark, sf))


@query("releases_of_month", "model_id:s ts:d variable:s observed:f expected:f", f"WITH {REL} SELECT * FROM rel WHERE month = DATE '1999-05-01'")
def releases_of_month(spark, sf):
    return _rel(bases.model_tables(spark, sf), "1999-05")


@query("release_impacts", "model_id:s ts:d variable:s impact:f gain_norm:f low:f high:f", f"""WITH {IMP} SELECT *, impact - 1.96 * measurement_error * CASE WHEN impact <> 0 THEN abs(impact) ELSE 1 END AS low,
    impact + 1.96 * measurement_error * CASE WHEN impact <> 0 THEN abs(impact) ELSE 1 END AS high FROM imp""")
def release_impacts(spark, sf):
    return _imp(spark, sf)


@query("news_contributions", "model_id:s month:d ts:d variable:s impact:f contribution_pct:f is_positive:b", f"WITH {IMP} SELECT * FROM con")
def news_contributions(spark, sf):
    return _con(spark, sf)


@query("impact_path", "model_id:s month:d ts:d impact:f baseline:f cumulative:f running:f total:f total_positive:f total_negative:f", f"""WITH {IMP},
    day AS (SELECT model_id, month, ts, sum(impact) AS impact, coalesce(sum(impact) FILTER (impact > 0), 0) AS up, coalesce(sum(impact) FILTER (impact < 0), 0) AS down FROM imp GROUP BY 1, 2, 3),
    b AS (SELECT m.model_id, m.month, n.v AS baseline FROM (SELECT DISTINCT model_id, month FROM rel) m ASOF LEFT JOIN @nowcast n ON n.model_id = m.model_id AND m.month >= n.d)
    SELECT model_id, month, ts, impact, baseline, sum(impact) OVER o AS cumulative, baseline + sum(impact) OVER o AS running, sum(impact) OVER w AS total, sum(up) OVER w AS total_positive, sum(down) OVER w AS total_negative
    FROM day LEFT JOIN b USING (model_id, month) WINDOW w AS (PARTITION BY model_id, month), o AS (PARTITION BY model_id, month ORDER BY ts)""")
def impact_path(spark, sf):
    imp = _imp(spark, sf)
    return window.running_impact(imp, news.baselines(imp, bases.nowcast(spark, sf)))


@query("variable_totals", "model_id:s month:d variable:s total_impact:f release_count:n average_impact:f contribution_pct:f", f"""WITH {IMP} SELECT model_id, month, variable, sum(impact) AS total_impact, count(*) AS release_count,
    avg(impact) AS average_impact, abs(sum(impact)) / sum(sum(abs(impact))) OVER (PARTITION BY model_id, month) * 100 AS contribution_pct FROM con GROUP BY 1, 2, 3""")
def variable_totals(spark, sf):
    return news.variable_totals(_con(spark, sf))


@query("normalized_impacts", "model_id:s month:d ts:d variable:s impact:f contribution_pct:f is_positive:b", f"WITH {NORM} SELECT * FROM nrm")
def normalized_impacts(spark, sf):
    return _norm(spark, sf)[0]


@query("normalization_info", "model_id:s month:d first_nowcast:f last_nowcast:f actual_change:f raw_total:f problem:s", f"WITH {NORM} SELECT * FROM inf")
def normalization_info(spark, sf):
    return _norm(spark, sf)[1]


RANK = """rk AS (SELECT model_id, month, variable, sum(impact) AS total_impact, avg(impact) AS avg_impact, sum(contribution_pct) AS total_contribution_pct, count(*) AS release_count,
    count(*) FILTER (is_positive) AS positive_count, stddev_pop(impact) AS consistency, max(abs(impact)) AS max_single_impact, count(*) FILTER (is_positive) / count(*) AS impact_ratio FROM con GROUP BY 1, 2, 3)"""
RANK_COLUMNS = "model_id:s month:d variable:s total_impact:f avg_impact:f total_contribution_pct:f release_count:n positive_count:n consistency:f max_single_impact:f impact_ratio:f rank:n"


def _rank_query(method, expr):
    @query(f"rank_variables_{method}", RANK_COLUMNS, f"WITH {IMP}, {RANK} SELECT *, rank() OVER (PARTITION BY model_id, month ORDER BY {expr} DESC) AS rank FROM rk")
    def run(spark, sf):
        return news.rank_variables(_con(spark, sf), method)


for _m, _e in (("total_impact", "abs(total_impact)"), ("avg_impact", "abs(avg_impact)"), ("contribution_pct", "total_contribution_pct"), ("frequency", "release_count")):
    _rank_query(_m, _e)


@query("key_drivers", "model_id:s month:d variable:s rank:n key_score:f tier:s frequent:b high_impact:b stable_up:b stable_down:b", f"""WITH {IMP}, {RANK},
    r AS (SELECT *, rank() OVER (PARTITION BY model_id, month ORDER BY total_contribution_pct DESC) AS rank, max(release_count) OVER (PARTITION BY model_id, month) AS mx FROM rk),
    k AS (SELECT *, total_contribution_pct * 0.4 + release_count / mx * 100 * 0.3 + impact_ratio * 100 * 0.3 AS key_score FROM r WHERE total_contribution_pct >= 10 OR rank <= 10)
    SELECT *, CASE WHEN rank <= 3 THEN 'primary' WHEN rank <= 10 THEN 'secondary' ELSE 'other' END AS tier, release_count > median(release_count) OVER w AS frequent,
      max_single_impact > median(max_single_impact) OVER w AS high_impact, impact_ratio >= 0.8 AS stable_up, impact_ratio <= 0.2 AS stable_down FROM k WINDOW w AS (PARTITION BY model_id, month)""")
def key_drivers(spark, sf):
    return news.key_drivers(_con(spark, sf))


@query("sign_split", "model_id:s month:d positive:f negative:f n_positive:n n_negative:n net:f positive_ratio:f negative_ratio:f balance:f", f"""WITH {IMP},
    s AS (SELECT model_id, month, coalesce(sum(impact) FILTER (is_positive), 0) AS positive, coalesce(sum(impact) FILTER (NOT is_positive), 0) AS negative, count(*) FILTER (is_positive) AS n_positive, count(*) FILTER (NOT is_positive) AS n_negative FROM con GROUP BY 1, 2)
    SELECT *, positive + negative AS net, coalesce(positive / nullif(positive + abs(negative), 0), 0) AS positive_ratio, coalesce(abs(negative) / nullif(positive + abs(negative), 0), 0) AS negative_ratio, abs(positive / nullif(negative, 0)) AS balance FROM s""")
def sign_split(spark, sf):
    return news.sign_split(_con(spark, sf))


@query("top_by_sign", "model_id:s month:d is_positive:b variable:s impact:f rank:n", f"""WITH {IMP}, p AS (SELECT model_id, month, is_positive, variable, sum(impact) AS impact FROM con GROUP BY 1, 2, 3, 4)
    SELECT *, rank() OVER (PARTITION BY model_id, month, is_positive ORDER BY abs(impact) DESC) AS rank FROM p QUALIFY rank <= 5""")
def top_by_sign(spark, sf):
    return news.top_by_sign(_con(spark, sf))


@query("industry_totals", "model_id:s month:d industry:s impact:f n:n positive:f negative:f contribution_pct:f", f"WITH {IND} SELECT * FROM it")
def industry_totals(spark, sf):
    return news.industry_totals(_ind(spark, sf))


@query("industry_by_date", "model_id:s month:d ts:d industry:s impact:f positive:f negative:f", f"""WITH {IND},
    g AS (SELECT * FROM (SELECT DISTINCT model_id, month, ts FROM ni) JOIN (SELECT DISTINCT model_id, industry FROM ni) USING (model_id)),
    c AS (SELECT model_id, month, ts, industry, sum(impact) AS impact, sum(impact) FILTER (impact > 0) AS positive, sum(impact) FILTER (impact < 0) AS negative FROM ni GROUP BY 1, 2, 3, 4)
    SELECT model_id, month, ts, industry, coalesce(impact, 0) AS impact, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM g LEFT JOIN c USING (model_id, month, ts, industry)""")
def industry_by_date(spark, sf):
    return news.industry_by_date(_ind(spark, sf))


@query("industry_ranking", "model_id:s month:d industry:s impact:f rank:n", f"WITH {IND} SELECT *, rank() OVER (PARTITION BY model_id, month ORDER BY abs(impact) DESC) AS rank FROM it QUALIFY rank <= 3")
def industry_ranking(spark, sf):
    return news.industry_ranking(news.industry_totals(_ind(spark, sf)), top_n=3)


@query("industry_extremes", "model_id:s month:d n:n top_positive:s max_positive:f top_negative:s max_negative:f", f"""WITH {IND} SELECT model_id, month, count(*) AS n, arg_max(industry, (positive, industry)) AS top_positive, max(positive) AS max_positive,
    arg_min(industry, (negative, industry)) AS top_negative, min(negative) AS max_negative FROM it GROUP BY 1, 2""")
def industry_extremes(spark, sf):
    return news.industry_extremes(news.industry_totals(_ind(spark, sf)))


@query("data_flow", "model_id:s ts:d variable:s observed:f impact:f nowcast:f", f"WITH {NORM} SELECT nrm.model_id, ts, variable, observed, impact, n.v AS nowcast FROM nrm ASOF LEFT JOIN @nowcast n ON n.model_id = nrm.model_id AND nrm.ts >= n.d")
def data_flow(spark, sf):
    return news.data_flow(_norm(spark, sf)[0], bases.nowcast(spark, sf))


@query("date_summary", "model_id:s ts:d n:n total:f positive:f negative:f", f"""WITH {IMP} SELECT model_id, ts, count(*) AS n, sum(impact) AS total, coalesce(sum(impact) FILTER (impact > 0), 0) AS positive,
    coalesce(sum(impact) FILTER (impact < 0), 0) AS negative FROM con GROUP BY 1, 2""")
def date_summary(spark, sf):
    return news.date_summary(_con(spark, sf))


@query("model_summary", "model_id:s n_steps:n n_factors:n n_variables:n max_gain:f mean_gain:f", """WITH f AS (SELECT *, min(d) OVER (PARTITION BY model_id) AS f FROM @gains)
    SELECT model_id, count(DISTINCT d) AS n_steps, count(DISTINCT factor) AS n_factors, count(DISTINCT variable) AS n_variables, max(abs(gain)) FILTER (d = f) AS max_gain, avg(abs(gain)) FILTER (d = f) AS mean_gain FROM f GROUP BY 1""")
def model_summary(spark, sf):
    return news.model_summary(bases.model_tables(spark, sf)["gains"])

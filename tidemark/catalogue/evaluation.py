"""Alignment with targets, metrics, scores."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.operators import evaluation as ev

TRAIN_END, VAL_START, VAL_END, OBS_END = "1998-12-25", "1999-01-01", "1999-12-31", "2000-12-29"
MONTHLY = "mt AS (SELECT model_id, CAST(date_trunc('month', d) AS DATE) AS month, arg_max(v, d) AS target FROM @target WHERE v IS NOT NULL GROUP BY 1, 2)"
WEEKS = "nw AS (SELECT model_id, d, v, CAST(date_trunc('month', d) AS DATE) AS month FROM @nowcast)"
LAST = "lf AS (SELECT model_id, month, max(d) AS d, arg_max(v, d) AS v FROM nw GROUP BY 1, 2)"


def _inputs(spark, sf):
    return bases.nowcast(spark, sf), bases.target(spark, sf)


def _pairs_queries(mode, k):
    @query(f"weekly_pairs_{mode}", "model_id:s month:d d:d v:f target:f", f"""WITH {MONTHLY}, {WEEKS} SELECT nw.*, mt.target FROM nw JOIN mt
        ON mt.model_id = nw.model_id AND mt.month = nw.month + INTERVAL {k} MONTH""")
    def weekly(spark, sf):
        return ev.weekly_pairs(*_inputs(spark, sf), mode)

    @query(f"last_friday_pairs_{mode}", "model_id:s month:d d:d v:f reference:f target:f", f"""WITH {MONTHLY}, {WEEKS}, {LAST} SELECT lf.*, a.target AS reference, b.target FROM lf
        JOIN mt a ON a.model_id = lf.model_id AND a.month = lf.month + INTERVAL ({k - 1}) MONTH JOIN mt b ON b.model_id = lf.model_id AND b.month = lf.month + INTERVAL {k} MONTH""")
    def fridays(spark, sf):
        return ev.last_friday_pairs(*_inputs(spark, sf), mode)

    @query(f"metrics_{mode}", "model_id:s rmse:f mae:f win_rate:f", f"""WITH {MONTHLY}, {WEEKS}, {LAST},
        w AS (SELECT nw.model_id, sqrt(avg((v - b.target) ** 2)) AS rmse, avg(CASE WHEN a.target IS NOT NULL THEN CASE WHEN sign(v - a.target) = sign(b.target - a.target) THEN 100.0 ELSE 0.0 END END) AS win_rate
          FROM nw JOIN mt b ON b.model_id = nw.model_id AND b.month = nw.month + INTERVAL {k} MONTH LEFT JOIN mt a ON a.model_id = nw.model_id AND a.month = nw.month + INTERVAL ({k - 1}) MONTH GROUP BY 1),
        f AS (SELECT lf.model_id, avg(abs(v - b.target)) AS mae FROM lf JOIN mt b ON b.model_id = lf.model_id AND b.month = lf.month + INTERVAL {k} MONTH
          JOIN mt a ON a.model_id = lf.model_id AND a.month = lf.month + INTERVAL ({k - 1}) MONTH GROUP BY 1) SELECT * FROM w JOIN f USING (model_id)""")
    def measured(spark, sf):
        return ev.metrics(*_inputs(spark, sf), mode)


for _m, _k in (("next_month", 1), ("current_month", 0)):
    _pairs_queries(_m, _k)

PERIOD = (f"CASE WHEN d <= DATE '{TRAIN_END}' THEN 'training' WHEN d BETWEEN DATE '{VAL_START}' AND DATE '{VAL_END}' THEN 'validation' "
          f"WHEN d >= DATE '{VAL_END}' + 7 {{end}} THEN 'observation' END")
BOUNDED = PERIOD.format(end=f"AND d <= DATE '{OBS_END}'")


@query("metrics_by_period", "model_id:s period:s rmse:f mae:f win_rate:f", f"""
    WITH tg AS (SELECT *, {BOUNDED} AS own FROM @target), tp AS (SELECT model_id, d, v, own AS period FROM tg WHERE own IN ('training', 'observation') UNION ALL SELECT model_id, d, v, 'validation' FROM tg),
    mt AS (SELECT model_id, period, CAST(date_trunc('month', d) AS DATE) AS month, arg_max(v, d) AS target FROM tp GROUP BY 1, 2, 3),
    nw AS (SELECT model_id, d, v, CAST(date_trunc('month', d) AS DATE) AS month, {BOUNDED} AS period FROM @nowcast),
    lf AS (SELECT model_id, period, month, max(d) AS d, arg_max(v, d) AS v FROM nw WHERE period IS NOT NULL GROUP BY 1, 2, 3),
    w AS (SELECT nw.model_id, nw.period, sqrt(avg((v - b.target) ** 2)) AS rmse, avg(CASE WHEN a.target IS NOT NULL THEN CASE WHEN sign(v - a.target) = sign(b.target - a.target) THEN 100.0 ELSE 0.0 END END) AS win_rate
      FROM nw JOIN mt b ON b.model_id = nw.model_id AND b.period = nw.period AND b.month = nw.month + INTERVAL 1 MONTH LEFT JOIN mt a ON a.model_id = nw.model_id AND a.period = nw.period AND a.month = nw.month GROUP BY 1, 2),
    f AS (SELECT lf.model_id, lf.period, avg(abs(v - b.target)) AS mae FROM lf JOIN mt b ON b.model_id = lf.model_id AND b.period = lf.period AND b.month = lf.month + INTERVAL 1 MONTH
      JOIN mt a ON a.model_id = lf.model_id AND a.period = lf.period AND a.month = lf.month GROUP BY 1, 2) SELECT * FROM w JOIN f USING (model_id, period)""")
def metrics_by_period(spark, sf):
    return ev.evaluate_periods(*_inputs(spark, sf), TRAIN_END, VAL_START, VAL_END, OBS_END)


@query("target_statistics", "model_id:s mean:f std:f", "SELECT model_id, avg(v) AS mean, stddev_samp(v) AS std FROM @target GROUP BY 1")
def target_statistics(spark, sf):
    return ev.target_statistics(bases.target(spark, sf))


@query("period_bounds_by_model", "model_id:s period:s first_date:d last_date:d n:n", f"""SELECT model_id, {PERIOD.format(end='')} AS period, min(d) AS first_date, max(d) AS last_date, count(*) AS n
    FROM @nowcast WHERE {PERIOD.format(end='')} IS NOT NULL GROUP BY 1, 2""")
def period_bounds_by_model(spark, sf):
    return ev.period_bounds(bases.nowcast(spark, sf), TRAIN_END, VAL_START, VAL_END)


@query("aligned_table", "model_id:s d:d nowcast:f target:f", f"""WITH {MONTHLY}, {WEEKS}, {LAST}
    SELECT nw.model_id, nw.d, nw.v AS nowcast, mt.target FROM nw LEFT JOIN lf ON lf.model_id = nw.model_id AND lf.d = nw.d LEFT JOIN mt ON mt.model_id = lf.model_id AND mt.month = lf.month + INTERVAL 1 MONTH""")
def aligned_table(spark, sf):
    nowcast, target = _inputs(spark, sf)
    early = nowcast.filter(F.col("d") <= F.lit(TRAIN_END).cast("date"))
    late = nowcast.filter(F.col("d") > F.lit(TRAIN_END).cast("date"))
    return ev.aligned_table([early, late], target)


# Candidate scores per model from weekly errors of each supplier nation.
SCORES = """sc AS (SELECT model_id, variable AS candidate_id, sqrt(avg(observed ** 2) FILTER (d < DATE '1999-01-01')) AS is_rmse, sqrt(avg(observed ** 2) FILTER (d >= DATE '1999-01-01')) AS oos_rmse,
      avg(CASE WHEN observed > 0.5 THEN 100.0 ELSE 0.0 END) FILTER (d < DATE '1999-01-01') AS is_win, CASE WHEN count(*) > 40 THEN avg(CASE WHEN observed > 0.5 THEN 100.0 ELSE 0.0 END) FILTER (d >= DATE '1999-01-01') END AS oos_win FROM @observed GROUP BY 1, 2),
    ws AS (SELECT *, is_rmse * 0.3 + oos_rmse * 0.7 AS rmse, CASE WHEN is_rmse * 0.3 + oos_rmse * 0.7 IS NOT NULL THEN is_win * 0.3 + oos_win * 0.7 END AS win_rate FROM sc)"""


def _scored(spark, sf):
    early = F.col("d") < F.lit("1999-01-01").cast("date")
    o = F.col("observed")
    win = F.when(o > 0.5, 100.0).otherwise(0.0)
    s = bases.observed(spark, sf).groupBy("model_id", F.col("variable").alias("candidate_id")).agg(
        F.sqrt(F.avg(F.when(early, o * o))).alias("is_rmse"), F.sqrt(F.avg(F.when(~early, o * o))).alias("oos_rmse"),
        F.avg(F.when(early, win)).alias("is_win"), F.when(F.count(F.lit(1)) > 40, F.avg(F.when(~early, win))).alias("oos_win"))
    return s.withColumn("score", ev.weighted_score(*map(F.col, ("is_rmse", "oos_rmse", "is_win", "oos_win")), 0.3))


@query("weighted_scores", "model_id:s candidate_id:s rmse:f win_rate:f", f"WITH {SCORES} SELECT * FROM ws")
def weighted_scores(spark, sf):
    return _scored(spark, sf).select("model_id", "candidate_id", "score.*")


CMP = """CASE WHEN {a}.rmse IS NULL AND {b}.rmse IS NULL THEN 0 WHEN {a}.rmse IS NULL THEN -1 WHEN {b}.rmse IS NULL THEN 1
    WHEN {a}.win_rate IS NULL OR {b}.win_rate IS NULL OR abs({a}.win_rate - {b}.win_rate) > 5 THEN
      CASE WHEN {win} <> 0 THEN {win} ELSE sign({b}.rmse - {a}.rmse) END ELSE CASE WHEN {a}.rmse <> {b}.rmse THEN sign({b}.rmse - {a}.rmse) ELSE {win} END END"""
WIN = "(CASE WHEN {a}.win_rate IS NULL AND {b}.win_rate IS NULL THEN 0 WHEN {a}.win_rate IS NULL THEN -1 WHEN {b}.win_rate IS NULL THEN 1 ELSE sign({a}.win_rate - {b}.win_rate) END)"


def _cmp(a, b):
    return CMP.format(a=a, b=b, win=WIN.format(a=a, b=b))


@query("compare_scores", "candidate_id:s verdict:n", f"""WITH {SCORES} SELECT x.candidate_id, {_cmp('x', 'y')} AS verdict
    FROM (SELECT * FROM ws WHERE model_id = 'F') x JOIN (SELECT * FROM ws WHERE model_id = 'O') y USING (candidate_id)""")
def compare_scores(spark, sf):
    s = _scored(spark, sf)
    x = s.filter("model_id = 'F'").select("candidate_id", F.col("score").alias("a"))
    y = s.filter("model_id = 'O'").select("candidate_id", F.col("score").alias("b"))
    return x.join(y, "candidate_id").select("candidate_id", ev.compare_scores(F.col("a"), F.col("b")).alias("verdict"))


@query("best_candidate", "model_id:s candidate_id:s rmse:f win_rate:f", f"""
    WITH RECURSIVE {SCORES}, o AS (SELECT model_id, candidate_id, rmse, win_rate, row_number() OVER (PARTITION BY model_id ORDER BY candidate_id) AS i FROM ws),
    f AS (SELECT model_id, i, CASE WHEN rmse IS NOT NULL THEN candidate_id END AS candidate_id, rmse, CASE WHEN rmse IS NOT NULL THEN win_rate END AS win_rate FROM o WHERE i = 1
      UNION ALL SELECT n.model_id, n.i, CASE WHEN n.rmse IS NOT NULL AND {_cmp('n', 'f')} > 0 THEN n.candidate_id ELSE f.candidate_id END, CASE WHEN n.rmse IS NOT NULL AND {_cmp('n', 'f')} > 0 THEN n.rmse ELSE f.rmse END,
        CASE WHEN n.rmse IS NOT NULL AND {_cmp('n', 'f')} > 0 THEN n.win_rate ELSE f.win_rate END FROM f JOIN o n ON n.model_id = f.model_id AND n.i = f.i + 1)
    SELECT model_id, candidate_id, rmse, win_rate FROM f QUALIFY i = max(i) OVER (PARTITION BY model_id)""")
def best_candidate(spark, sf):
    return ev.best_candidate(_scored(spark, sf), ["model_id"])

"""Panels, factors, models, selection, pipelines."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.alignment import SPINE, _mixed, aligned_sql, bounds
from tidemark.catalogue.registry import query
from tidemark.operators import factor, selection, stationarity, window
from tidemark.plans.nowcast import train
from tidemark.plans.panel import panel_report, prepare_panel
from tidemark.plans.revision import analyse
from tidemark.sources import scan, sinks

T0, T1, V0, V1 = "1995-01-06", "1998-12-25", "1999-01-01", "2000-12-29"

# A balanced weekly panel: every variable on every week, missing where nothing shipped.
GRID = """pn AS (SELECT l_linestatus AS model_id, r_name || '/' || l_returnflag AS variable,
      CAST(l_shipdate AS DATE) + CAST((5 - isodow(CAST(l_shipdate AS DATE)) + 7) % 7 AS INTEGER) AS d, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 7919000e0 AS v
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
    fa AS (SELECT l_linestatus AS model_id, CAST(l_shipdate AS DATE) + CAST((5 - isodow(CAST(l_shipdate AS DATE)) + 7) % 7 AS INTEGER) AS d,
      CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 3e0 - 1.5 AS f1, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 3e0 - 1.2 AS f2 FROM lineitem GROUP BY 1, 2)"""


def _panel(spark, sf):
    """The balanced panel of each line status: a variable per region and return flag.

    Fits read a panel many times; its weekly sums, bounded by the calendar, are
    written once, so that the lines are read once."""
    from tidemark.session import cut_lineage
    name = F.concat_ws("/", "r_name", "l_returnflag")
    t = lambda n: bases.table(spark, sf, n)
    place = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    sums = cut_lineage(t("lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("l_linestatus").alias("model_id"), name.alias("variable"),
        bases._friday("l_shipdate").alias("d")).agg(bases._total(bases._cents("l_extendedprice")).alias("v")))
    weeks = sums.groupBy("model_id").agg(F.collect_set("d").alias("w"))
    grid = sums.select("model_id", "variable").distinct().join(weeks, "model_id").select(
        "model_id", "variable", F.explode("w").alias("d"))
    return grid.join(sums, ["model_id", "variable", "d"], "left")


def _factors(spark, sf):
    mean = lambda c, shift: F.sum(bases._cents(c)).cast("double") / F.count(F.lit(1)) / F.lit(3.0) - F.lit(shift)
    wide = bases.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("model_id"), bases._friday("l_shipdate").alias("d")).agg(
        mean("l_discount", 1.5).alias("1"), mean("l_tax", 1.2).alias("2"))
    return wide.unpivot(["model_id", "d"], ["1", "2"], "factor", "v").withColumn("factor", F.col("factor").cast("int"))


@query("processing_log", "variable:s state:s detail:s p_value:s stationary:s")
def processing_log(spark, sf):
    from tidemark.operators import clean
    ticks = bases.ticks(spark, sf)
    panel = bases.monthly(spark, sf)
    removed = clean.removal_log(ticks)
    replaced = panel.groupBy("series").agg(F.count_if(F.col("v") > 30).alias("n")).withColumn("rule", F.lit("大于 30"))
    return sinks.processing_log(panel, removed, replaced, results=stationarity.test_stationarity(panel))


@query("clear_non_stationary", "name:s is_predictor:b", """WITH r AS (SELECT name, CASE WHEN freq = 'D' THEN '否' WHEN freq = 'W' THEN '是' END AS s FROM @dictionary WHERE freq IN ('D', 'W'))
    SELECT dd.name, is_predictor AND coalesce(s = '是', true) AS is_predictor FROM @dictionary dd LEFT JOIN r ON r.name = dd.name""")
def clear_non_stationary(spark, sf):
    d = bases.dictionary(spark, sf)
    results = d.filter(F.col("freq").isin("D", "W")).select(F.col("name").alias("series"), F.when(F.col("freq") == "D", "否").otherwise("是").alias("status"))
    return sinks.clear_non_stationary(d, results)


def _prepared(spark, sf):
    mixed = _mixed(spark, sf)
    dictionary = mixed.select(F.lower("series").alias("name_norm"), "freq").distinct()
    obs = mixed.drop("freq").withColumn("src_pos", F.lit(0))
    return prepare_panel(obs, dictionary, "M:1-URGENT", *bounds(spark, sf), threshold=60)


@query("prepare_panel", "series:s d:d v:f", f"""WITH {aligned_sql(60)}, ok AS (SELECT series, d, max(v) AS v FROM al WHERE series NOT IN (SELECT series FROM bad) GROUP BY 1, 2),
    g AS (SELECT s.series, p.d, ok.v FROM (SELECT DISTINCT series FROM ok) s CROSS JOIN ({SPINE}) p LEFT JOIN ok ON ok.series = s.series AND ok.d = p.d)
    SELECT * FROM g WHERE series IN (SELECT series FROM g WHERE v IS NOT NULL)""")
def prepared(spark, sf):
    return _prepared(spark, sf)


@query("panel_report", "series:s n_valid:n p_value:f status:s priority:n")
def report(spark, sf):
    return panel_report(_prepared(spark, sf))


@query("principal_components", "model_id:s component:n eigenvalue:f ratio:f cumulative:f")
def principal_components(spark, sf):
    return factor.spectrum(_panel(spark, sf), T0, T1)


@query("component_traces", "model_id:s total:f squares:f", f"""WITH {GRID}, t AS (SELECT g.model_id, g.variable, g.d, pn.v FROM (SELECT * FROM (SELECT DISTINCT model_id, variable FROM pn) a JOIN (SELECT DISTINCT model_id AS m, d FROM pn) b ON a.model_id = b.m) g
      LEFT JOIN pn ON pn.model_id = g.model_id AND pn.variable = g.variable AND pn.d = g.d WHERE g.d BETWEEN DATE '{T0}' AND DATE '{T1}'),
    m AS (SELECT model_id, variable, avg(v) AS mu, stddev_samp(v) AS sd FROM t GROUP BY 1, 2 HAVING count(v) > 1 AND min(v) < max(v)),
    z AS (SELECT t.model_id, t.variable, d, coalesce((v - mu) / sd, 0) AS z FROM t JOIN m ON m.model_id = t.model_id AND m.variable = t.variable),
    c AS (SELECT a.model_id, a.variable AS x, b.variable AS y, covar_samp(a.z, b.z) AS c FROM z a JOIN z b ON a.model_id = b.model_id AND a.d = b.d GROUP BY 1, 2, 3)
    SELECT model_id, sum(c) FILTER (x = y) AS total, sum(c * c) AS squares FROM c GROUP BY 1""")
def component_traces(spark, sf):
    """Sum and sum of squares of all eigenvalues: trace and squared norm of the correlations."""
    c = factor.spectrum(_panel(spark, sf), T0, T1)
    return c.groupBy("model_id").agg(F.sum("eigenvalue").alias("total"), F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squares"))


@query("factor_count", "model_id:s k:n rule:s problem:s")
def factor_count(spark, sf):
    from tidemark.session import cut_lineage
    c = cut_lineage(factor.spectrum(_panel(spark, sf), T0, T1))
    out = None
    for rule in ("fixed", "cumulative", "elbow", "kaiser"):
        part = factor.choose_factors(c, rule).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out


@query("static_factors", "model_id:s d:d factor:n v:f")
def static_factors(spark, sf):
    return factor.scores(factor.static_factors(_panel(spark, sf), 2, T0, T1)[0], 2)


OLS = """nrm AS (SELECT {keys}, count(*) AS n, sum(f1 * f1) AS a, sum(f1 * f2) AS b, sum(f2 * f2) AS c, sum(f1 * y) AS p, sum(f2 * y) AS q FROM {rows} WHERE y IS NOT NULL GROUP BY ALL),
    sol AS (SELECT {keys}, n, (p * c - q * b) / (a * c - b * b) AS h1, (q * a - p * b) / (a * c - b * b) AS h2 FROM nrm)"""


@query("estimate_loadings", "model_id:s variable:s n:n factor:n loading:f", f"""WITH {GRID}, rows AS (SELECT pn.model_id, variable, f1, f2, v AS y FROM pn JOIN fa ON fa.model_id = pn.model_id AND fa.d = pn.d WHERE pn.d <= DATE '{T1}'),
    {OLS.format(keys='model_id, variable', rows='rows')} SELECT model_id, variable, n, 1 AS factor, CASE WHEN n >= 4 THEN h1 END AS loading FROM sol UNION ALL SELECT model_id, variable, n, 2, CASE WHEN n >= 4 THEN h2 END FROM sol""")
def estimate_loadings(spark, sf):
    return factor.estimate_loadings(_panel(spark, sf), _factors(spark, sf), 2, T1)


FORECAST = f"""WITH {GRID}, j AS (SELECT fa.*, n.v AS t, fa.d BETWEEN DATE '{T0}' AND DATE '{T1}' AS tr FROM fa LEFT JOIN @nowcast n ON n.model_id = fa.model_id AND n.d = fa.d),
    m AS (SELECT model_id, avg(t) FILTER (tr) AS mu, stddev_samp(t) FILTER (tr) AS sd FROM j GROUP BY 1), rows AS (SELECT j.model_id, f1, f2, (t - mu) / sd AS y FROM j JOIN m USING (model_id) WHERE tr),
    {OLS.format(keys='model_id', rows='rows')}"""


@query("target_forecast", "model_id:s d:d v:f", FORECAST + "SELECT fa.model_id, d, (f1 * h1 + f2 * h2) * sd + mu AS v FROM fa JOIN sol USING (model_id) JOIN m USING (model_id)")
def target_forecast(spark, sf):
    return factor.forecast(_factors(spark, sf), bases.nowcast(spark, sf), 2, T0, T1)[0]


@query("target_loading", "model_id:s factor:n loading:f target_std:f", FORECAST + "SELECT model_id, 1 AS factor, h1 AS loading, sd AS target_std FROM sol JOIN m USING (model_id) UNION ALL SELECT model_id, 2, h2, sd FROM sol JOIN m USING (model_id)")
def target_loading(spark, sf):
    return factor.forecast(_factors(spark, sf), bases.nowcast(spark, sf), 2, T0, T1)[1]


def _fit(spark, sf):
    return factor.fit(_panel(spark, sf), 2, T0, T1)


@query("dynamic_convergence", "model_id:s rounds:n converged:b")
def dynamic_convergence(spark, sf):
    return _fit(spark, sf)["log"]




@query("dynamic_factors", "model_id:s d:d factor:n v:f")
def dynamic_factors(spark, sf):
    return _fit(spark, sf)["factors"]


@query("dynamic_gains", "model_id:s d:d variable:s factor:n gain:f")
def dynamic_gains(spark, sf):
    return _fit(spark, sf)["gains"]


@query("dynamic_loadings", "model_id:s variable:s factor:n loading:f")
def dynamic_loadings(spark, sf):
    return _fit(spark, sf)["loadings"]


def _one(panel, nowcast, model):
    """The target of one model with its candidate predictors, as series."""
    p = panel.filter(F.col("model_id") == model).select(F.col("variable").alias("series"), "d", "v")
    t = nowcast.filter(F.col("model_id") == model).select(F.lit("target").alias("series"), "d", "v")
    return p.unionByName(t)


def _names(panel):
    """All variables of a panel but the target."""
    return sorted(r[0] for r in panel.filter("series <> 'target'").select("series").distinct().collect())


SETTING = selection.Setting("target", 1, T0, T1, V0, V1)


def _each_model(spark, sf, fn):
    """``fn(panel, names)`` of every model with all its variables, tagged.
    Models are worked on side by side, their jobs share the cluster."""
    from tidemark.session import cut_lineage
    panel, nowcast = cut_lineage(_panel(spark, sf)), cut_lineage(bases.nowcast(spark, sf))
    models = sorted(r[0] for r in panel.select("model_id").distinct().collect())

    def work(model):
        one = _one(panel, nowcast, model)
        return fn(one, _names(one)).withColumn("panel", F.lit(model))

    with ThreadPoolExecutor(max(1, len(models))) as pool:
        return reduce(lambda a, b: a.unionByName(b), pool.map(work, models))


@query("selection_round", "panel:s candidate_id:s is_rmse:f oos_rmse:f is_win:f oos_win:f rounds:n converged:b")
def selection_round(spark, sf):
    return _each_model(spark, sf, lambda p, names: selection.change_one(p, names, names, SETTING, "remove"))


@query("stepwise_selection", "panel:s step:n action:s variable:s n_variables:n win_rate:f rmse:f rounds:n converged:b")
def stepwise_selection(spark, sf):
    return _each_model(spark, sf, lambda p, names: selection.stepwise(p, names, SETTING)[1])


@query("backward_selection", "panel:s step:n action:s variable:s n_variables:n win_rate:f rmse:f rounds:n converged:b")
def backward_selection(spark, sf):
    return _each_model(spark, sf, lambda p, names: selection.backward(p, names, SETTING)[1])


def _trained(panel, names):
    return train(panel, selection.Setting("target", 2, T0, T1, V0, V1), names)


@query("train_nowcast", "panel:s model_id:s period:s rmse:f mae:f win_rate:f")
def train_nowcast(spark, sf):
    return _each_model(spark, sf, lambda p, names: _trained(p, names)["metrics"])


@query("revision_analysis", "panel:s model_id:s month:d variable:s total_impact:f release_count:n contribution_pct:f")
def revision_analysis(spark, sf):
    def one(panel, names):
        observed = panel.select(F.lit("target").alias("model_id"), "d", F.col("series").alias("variable"), F.col("v").alias("observed"))
        return analyse(observed, _trained(panel, names), "target")["variables"]
    return _each_model(spark, sf, one)

"""Unit-root tests of many series and the transformations they drive."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import arrays, window
from tidemark.operators.align import infer_frequency

MIN_SAMPLES = 5

# Published MacKinnon response surfaces for one series, by
# regression: switch point, bounds, and polynomials below and above the switch.
SURFACES = {
    "c": (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (-2.89, -16.18, 0.70, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}

# Rows of a seasonal difference by inferred frequency.
SEASONAL_ROWS = {"Monthly": 12, "Quarterly": 4, "Weekly": 52, "Ten_Day": 3, "Annual": 1}


def _p_value(stat: float, regression: str) -> float:
    switch, low, high, below, above = SURFACES[regression]
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    z = sum(c * stat ** i for i, c in enumerate(below if stat <= switch else above))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _design(x: np.ndarray, lags: int, regression: str):
    """Differences and their regressors: trend terms, level, lagged differences."""
    dx = np.diff(x)
    y = dx[lags:]
    n = len(y)
    terms = [np.ones(n)] + ([np.arange(1, n + 1.0)] if regression == "ct" else [])
    cols = terms + [x[lags:-1]] + [dx[lags - i:len(dx) - i] for i in range(1, lags + 1)]
    return y, np.column_stack(cols), len(terms)


def _unit_root(x: np.ndarray, regression: str):
    """Augmented Dickey-Fuller p-value with the lag of least AIC over one sample."""
    n = len(x)
    if n < MIN_SAMPLES:
        return None, "数据不足"
    if x.min() == x.max():
        return None, "计算失败(ValueError)"
    longest = min(n // 2 - len(regression) - 1, math.ceil(12 * (n / 100) ** 0.25))
    if longest < 0:
        return None, "计算失败(ValueError)"
    y, X, k = _design(x, longest, regression)
    # One factorisation serves all nested lag choices: the residual sum of the
    # first m columns is |y|^2 minus its first m squared projections.
    q, _ = np.linalg.qr(X)
    rss = float(y @ y) - np.cumsum((q.T @ y) ** 2)
    sizes = np.arange(k + 1, X.shape[1] + 1)
    aic = len(y) * np.log(np.maximum(rss[sizes - 1], 1e-300) / len(y)) + 2 * sizes
    y, X, k = _design(x, int(np.argmin(aic)), regression)
    free = len(y) - X.shape[1]
    if free <= 0:
        return None, "计算失败(自由度不足)"
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    residual = y - X @ beta
    variance = float(residual @ residual) / free * np.linalg.pinv(X.T @ X)[k, k]
    if not variance > 0:
        return None, "计算失败(自由度不足)"
    return _p_value(float(beta[k] / math.sqrt(variance)), regression), None


def _adf_udf(regression: str):
    schema = T.StructType([T.StructField("p_value", T.DoubleType()), T.StructField("failure", T.StringType())])

    @F.pandas_udf(schema)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_unit_root(np.asarray(v, dtype=float), regression) for v in values],
                            columns=["p_value", "failure"]).astype({"p_value": "float64", "failure": "object"})
    return run


def test_stationarity(obs: DataFrame, alpha: float = 0.05, regression: str = "ct",
                      keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Unit-root test of every series: valid count, p-value and status text.

    Exploration uses constant and trend (``ct``), preparation a constant only
    (``c``).  Series are arrays in ordinary rows, so any number of them spreads
    over the cluster in Arrow batches."""
    tested = arrays.series_arrays(obs, keys).withColumn("_r", _adf_udf(regression)(F.col("values")))
    status = F.coalesce(F.col("_r.failure"), F.when(F.col("_r.p_value") < alpha, "是").otherwise("否"))
    return tested.select(*keys, F.size("values").alias("n_valid"), F.col("_r.p_value").alias("p_value"), status.alias("status"))


def formatted_status(report: DataFrame) -> DataFrame:
    """Adds a readable line such as ``ADF-P=0.012 (平稳)``."""
    word = F.when(F.col("status") == "是", "平稳").otherwise("非平稳")
    text = F.when(F.col("p_value").isNull(), F.col("status")).otherwise(
        F.format_string("ADF-P=%.3f (%s)", "p_value", word))
    return report.withColumn("formatted", text)


def transform_and_test(obs: DataFrame, config: DataFrame, freq: str = "W-FRI", alpha: float = 0.05) -> DataFrame:
    """Every variable's own chain, then one test job; problems first."""
    from tidemark.operators.rank import problem_variables_first
    tested = test_stationarity(window.transform(obs, config, freq), alpha)
    ops = config.select(F.col("variable").alias("series"), F.array_join(
        F.filter("ops", lambda o: o != "none"), " -> ").alias("ops"))
    named = tested.join(ops, "series", "left").withColumn(
        "processing", F.when(F.coalesce("ops", F.lit("")) == "", "不处理").otherwise(F.col("ops"))).drop("ops")
    return problem_variables_first(named)


def status_counts(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("status") == "是").alias("stationary"),
                      F.count_if(F.col("status") == "数据不足").alias("insufficient"),
                      F.count_if(~F.col("status").isin("是", "数据不足")).alias("non_stationary"))


def difference_until_stationary(obs: DataFrame, method: str = "diff", order: int = 1,
                                alpha: float = 0.05) -> DataFrame:
    """Test levels; difference what is not stationary and test again.

    Both tests run in one job over tagged copies, and only the levels decide
    whether the differenced result counts.  ``keep`` reports levels only."""
    use_log = method in ("log_diff", "log_then_diff")
    label = f"{order}阶对数差分" if use_log else f"{order}阶差分"
    level = obs.select("series", "d", "v", F.lit("level").alias("form"))
    changed = window.diff_order(obs, order, use_log).select("series", "d", "v", F.lit("changed").alias("form"))
    both = level if method == "keep" else level.unionByName(changed)
    tests = test_stationarity(both, alpha, keys=("series", "form"))
    pick = lambda form, c: F.max(F.when(F.col("form") == form, F.col(c)))
    out = tests.groupBy("series").agg(pick("level", "p_value").alias("original_p"), pick("level", "status").alias("original_status"),
                                      pick("changed", "p_value").alias("changed_p"), pick("changed", "status").alias("changed_status"))
    low = obs.groupBy("series").agg(F.min("v").alias("_low"))
    poor = F.col("original_status") == "否"
    bad_log = F.lit(use_log) & ~(F.col("_low") > 0)
    act = poor & F.lit(method != "keep")
    return out.join(low, "series").select(
        "series", "original_p", "original_status",
        F.when(~poor, "原始序列").when(F.lit(method == "keep"), "保留原始 (非平稳)")
        .when(bad_log, label + " (无法应用对数)").otherwise(label).alias("method"),
        F.when(act & ~bad_log, F.col("changed_p")).alias("processed_p"),
        F.when(act & bad_log, F.lit("否")).when(act, F.col("changed_status")).otherwise(F.col("original_status")).alias("final_status"))


def processed_series(obs: DataFrame, report: DataFrame, method: str = "diff", order: int = 1) -> DataFrame:
    """Original series plus the differenced ones that became stationary, renamed."""
    use_log = method in ("log_diff", "log_then_diff")
    won = report.filter((F.col("original_status") == "否") & (F.col("final_status") == "是")).select("series")
    suffix = ("_log_diff" if use_log else "_diff") + str(order)
    changed = window.diff_order(obs, order, use_log).join(won, "series", "left_semi")
    return obs.select("series", "d", "v").unionByName(
        changed.select(F.concat("series", F.lit(suffix)).alias("series"), "d", "v"))


def recommend_differencing(obs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Whether one-step or seasonal differencing makes each series stationary.

    The seasonal step is a lag of the inferred frequency's rows.  Both options
    are tested in one job."""
    labels = infer_frequency(obs).select("series", "label")
    rows = F.element_at(F.create_map(*[F.lit(x) for kv in SEASONAL_ROWS.items() for x in kv]), F.col("label"))
    tagged = obs.join(labels, "series").withColumn("_k", rows)
    step = window.diff_lag(obs, 1).select("series", "d", "v", F.lit("step").alias("form"))
    seasonal = None
    for k in sorted(set(SEASONAL_ROWS.values())):
        part = window.diff_lag(tagged.filter(F.col("_k") == k).select("series", "d", "v"), k)
        seasonal = part if seasonal is None else seasonal.unionByName(part)
    options = step.unionByName(seasonal.select("series", "d", "v", F.lit("season").alias("form")))
    tests = test_stationarity(options, alpha, keys=("series", "form"))
    word = F.when(F.col("status") == "是", "平稳").when(F.col("status") == "否", "非平稳").otherwise("无法计算")
    wide = tests.groupBy("series").agg(F.max(F.when(F.col("form") == "step", word)).alias("step"),
                                       F.max(F.when(F.col("form") == "season", word)).alias("season"))
    n = obs.groupBy("series").agg(F.count("v").alias("n"))
    out = n.join(labels, "series", "left").join(wide, "series", "left").withColumn("_k", rows)
    short = F.col("n") < MIN_SAMPLES
    season = F.when(F.col("_k").isNull() | (F.col("n") <= F.col("_k")), "不支持").otherwise(F.coalesce("season", F.lit("无法计算")))
    return out.select(
        "series", "label", F.when(short, "数据不足").otherwise(F.col("step")).alias("step"),
        F.when(short, "数据不足").otherwise(season).alias("season"),
        F.when(short, "不处理").when(F.col("step") == "平稳", "环比差分").when(season == "平稳", "同比差分")
        .otherwise("不处理").alias("recommended"))


def _changed(obs: DataFrame) -> DataFrame:
    """Log difference of all-positive series, plain difference of the others."""
    w = window.by_date()
    positive = F.min("v").over(window.whole()) > 0
    safe_log = F.ln(F.when(F.col("v") > 0, F.col("v")))
    return obs.select("series", "d", F.when(positive, safe_log - F.lag(safe_log).over(w)).otherwise(
        F.col("v") - F.lag("v").over(w)).alias("v"), F.when(positive, "log_diff").otherwise("diff").alias("kind"))


def ensure_stationary(obs: DataFrame, skip: tuple[str, ...] = (), alpha: float = 0.05) -> DataFrame:
    """Rule per series: keep the level, difference it, or drop it, with p-values.

    ``status`` is level, diff, log_diff (also with ``_still_nonstat``), or a
    skip reason; constant-only tests of both forms run in one job."""
    level = obs.select("series", "d", "v", F.lit("level").alias("form"))
    changed = _changed(obs).select("series", "d", "v", F.lit("changed").alias("form"))
    both = level.unionByName(changed)
    tests = test_stationarity(both, alpha, "c", ("series", "form"))
    shape = both.groupBy("series", "form").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    joined = tests.join(shape, ["series", "form"])
    pick = lambda form, c: F.max(F.when(F.col("form") == form, F.col(c))).alias(f"{form}_{c}")
    wide = joined.groupBy("series").agg(*[pick(f, c) for f in ("level", "changed") for c in ("p_value", "n", "lo", "hi")])
    c = F.col
    kind = F.when(c("level_lo") > 0, "log_diff").otherwise("diff")
    settled = c("level_p_value") < alpha
    status = (F.when(c("series").isin(list(skip)), "skipped_by_request").when(c("level_n") == 0, "skipped_empty")
              .when(c("level_lo") == c("level_hi"), "skipped_constant").when(settled, "level")
              .when(F.coalesce(c("changed_n"), F.lit(0)) == 0, F.concat(F.lit("skipped_"), kind, F.lit("_empty")))
              .when(c("changed_lo") == c("changed_hi"), F.concat(F.lit("skipped_"), kind, F.lit("_constant")))
              .when(c("changed_p_value") < alpha, kind).otherwise(F.concat(kind, F.lit("_still_nonstat"))))
    return wide.select("series", status.alias("status"), c("level_p_value").alias("original_p"),
                       F.when(~F.coalesce(settled, F.lit(False)), c("changed_p_value")).alias("diff_p"))


def apply_rules(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Replay stored rules ``(series, status)`` on new data; empty results drop."""
    w = window.by_date()
    logged = F.ln(F.when(F.col("v") > 0, F.col("v")))
    rule = F.regexp_replace("status", "_still_nonstat$", "")
    out = obs.join(rules.select("series", rule.alias("_rule")), "series").withColumn("v", (
        F.when(F.col("_rule") == "diff", F.col("v") - F.lag("v").over(w))
        .when(F.col("_rule") == "log_diff", logged - F.lag(logged).over(w)).otherwise(F.col("v"))))
    usable = out.filter(~F.col("_rule").startswith("skipped") | (F.col("_rule") == "skipped_by_request"))
    alive = usable.groupBy("series").agg(F.count("v").alias("n")).filter("n > 0").select("series")
    return usable.drop("_rule").join(alive, "series", "left_semi")

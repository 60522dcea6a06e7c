"""Properties and brute-force checks of pair, factor and news analytics."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, factor, lagged, news, rank, selection, stationarity, warping
from tidemark.operators.contribution import match_names

D = dt.date
FRIDAYS = [D(2020, 1, 3) + dt.timedelta(days=7 * i) for i in range(60)]


def long_panel(spark, values, model="m"):
    rows = [(model, FRIDAYS[t], f"x{i}", None if np.isnan(values[t, i]) else float(values[t, i]))
            for t in range(values.shape[0]) for i in range(values.shape[1])]
    return spark.createDataFrame(rows, "model_id string, d date, variable string, v double")


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    f = np.zeros((60, 2))
    for t in range(1, 60):
        f[t] = 0.7 * f[t - 1] + rng.normal(size=2)
    x = f @ rng.normal(size=(2, 6)) + 0.4 * rng.normal(size=(60, 6)) + 3
    x[rng.random(x.shape) < 0.1] = np.nan
    return x


TRAIN = (FRIDAYS[0].isoformat(), FRIDAYS[44].isoformat())


def standardized(x):
    mu, sd = np.nanmean(x[:45], axis=0), np.nanstd(x[:45], axis=0, ddof=1)
    return x - mu, np.nan_to_num((x - mu) / sd), sd


def test_spectrum_matches_a_dense_decomposition(spark, values):
    _, z, _ = standardized(values)
    z = z[:45] - z[:45].mean(axis=0)
    want = np.linalg.svd(z, compute_uv=False) ** 2
    got = [r["eigenvalue"] for r in factor.spectrum(long_panel(spark, values), *TRAIN).orderBy("component").collect()]
    assert np.allclose(got, want / 44)


def dense_em(x, k, rounds):
    """The same estimation with full innovation matrices, one date at a time."""
    y, z, sd = standardized(x)
    n = x.shape[1]
    u, s, vh = np.linalg.svd(z[:45], full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    f = (u * sign)[:, :k] * s[:k]
    v = (vh.T * sign)[:, :k]
    ols = lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]
    H = np.array([ols(f[~np.isnan(y[:45, i])], y[:45, i][~np.isnan(y[:45, i])]) for i in range(n)])
    R = np.maximum(np.var(z[:45] - f @ v.T, axis=0) * sd ** 2, 1e-6)
    X = np.column_stack([np.ones(44), f[:-1]])
    beta = ols(X, f[1:])
    A, Q = beta[1:].T, np.diag(np.diag(np.cov(f[1:] - X @ beta, rowvar=False)))
    x0, P0, T = np.zeros(k), np.eye(k), len(y)
    for _ in range(rounds):
        xf, xp, Pf, Pp, ll = np.zeros((T, k)), np.zeros((T, k)), [None] * T, [None] * T, 0.0
        gains = {}
        xf[0], Pf[0] = x0, P0
        for t in range(1, T):
            xp[t], Pp[t] = A @ xf[t - 1], A @ Pf[t - 1] @ A.T + Q + 1e-6 * np.eye(k)
            ix = np.where(~np.isnan(y[t]))[0]
            h, inn = H[ix], y[t, ix] - H[ix] @ xp[t]
            S = h @ Pp[t] @ h.T + np.diag(R[ix])
            K = Pp[t] @ h.T @ np.linalg.inv(S + 1e-4 * np.eye(len(ix)))
            gains[t] = (ix, K)
            xf[t], P = xp[t] + K @ inn, (np.eye(k) - K @ h) @ Pp[t]
            Pf[t] = (P + P.T) / 2
            ll -= 0.5 * (len(ix) * math.log(2 * math.pi) + np.linalg.slogdet(S)[1] + inn @ np.linalg.solve(S, inn))
        xs, Ps = xf.copy(), list(Pf)
        for t in range(T - 2, -1, -1):
            J = Pf[t] @ A.T @ np.linalg.inv(Pp[t + 1])
            xs[t] = xf[t] + J @ (xs[t + 1] - xp[t + 1])
            Ps[t] = Pf[t] + J @ (Ps[t + 1] - Pp[t + 1]) @ J.T
        H = np.array([ols(xs[~np.isnan(y[:, i])], y[:, i][~np.isnan(y[:, i])]) for i in range(n)])
        b, a = xs[:-1], xs[1:]
        A = a.T @ b @ np.linalg.inv(b.T @ b + 1e-7 * np.eye(k))
        w, V = np.linalg.eigh((a.T @ a - A @ (b.T @ b) @ A.T) / (T - 1))
        Q = V @ np.diag(np.maximum(w, 1e-7)) @ V.T
        R = np.maximum(np.nanvar(y - xs @ H.T, axis=0), 1e-7)
        x0, P0 = xs[0], Ps[0]
    return xs, xp, H, gains, ll


def test_dynamic_model_matches_a_dense_filter(spark, values):
    got = factor.fit(long_panel(spark, values), 2, *TRAIN, max_iter=2)
    xs, xp, H, gains, ll = dense_em(values, 2, 2)
    table = lambda df, c: df.toPandas().pivot(index="d", columns="factor", values=c).sort_index().to_numpy()
    assert np.allclose(table(got["factors"], "v"), xs, atol=1e-6)
    assert np.allclose(table(got["predicted"], "state")[1:], xp[1:], atol=1e-6)
    load = got["loadings"].toPandas().pivot(index="variable", columns="factor", values="loading").to_numpy()
    assert np.allclose(load, H, atol=1e-6)
    assert got["log"].first()["loglik"] == pytest.approx(ll, abs=1e-5)
    g = got["gains"].filter(F.col("d") == FRIDAYS[10]).toPandas().pivot(index="variable", columns="factor", values="gain")
    ix, K = gains[10]
    assert list(g.index) == [f"x{i}" for i in ix]
    assert np.allclose(g.to_numpy(), K.T, atol=1e-6)


def test_models_fitted_together_equal_models_fitted_alone(spark, values):
    a, b = long_panel(spark, values, "a"), long_panel(spark, values[:, ::-1] * 2, "b")
    together = factor.fit(a.unionByName(b), 1, *TRAIN, max_iter=2)["factors"].filter("model_id = 'b'")
    alone = factor.fit(b, 1, *TRAIN, max_iter=2)["factors"]
    table = lambda df: df.toPandas().sort_values("d")["v"].to_numpy()
    assert np.allclose(table(together), table(alone))


def test_selection_keeps_the_informative_variable(spark):
    rng = np.random.default_rng(3)
    driver = np.cumsum(rng.normal(size=60))
    data = {"target": driver + 0.01 * rng.normal(size=60), "good": driver + 0.05 * rng.normal(size=60),
            "noise": rng.normal(size=60), "other": rng.normal(size=60)}
    rows = [(n, FRIDAYS[t], float(v[t])) for n, v in data.items() for t in range(60)]
    panel = spark.createDataFrame(rows, "series string, d date, v double")
    s = selection.Setting("target", 1, *TRAIN, FRIDAYS[45].isoformat(), FRIDAYS[59].isoformat(), max_iter=1,
                          mode="current_month", rule={"criterion": "rmse"})
    chosen, history = selection.stepwise(panel, ["good", "noise", "other"], s)
    assert chosen[0] == "good"
    assert history.first()["action"] == "init"
    kept, steps = selection.backward(panel, ["good", "noise"], s)
    assert "good" in kept
    assert [r["rmse"] for r in steps.collect()] == sorted((r["rmse"] for r in steps.collect()), reverse=True)


def brute_dtw(a, b, r):
    n, m = len(a), len(b)
    c = np.full((n + 1, m + 1), np.inf)
    c[0, 0] = 0
    for i in range(n):
        for j in range(m):
            if i - max(0, n - m) - r < j < i + max(0, m - n) + r:
                c[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(c[i, j], c[i, j + 1], c[i + 1, j])
    return math.sqrt(c[n, m])


@pytest.mark.parametrize("n,m,r", [(12, 12, 1), (12, 12, 3), (10, 17, 4), (17, 10, 2), (20, 20, None)])
def test_warping_matches_brute_force(n, m, r):
    rng = np.random.default_rng(n * m)
    a, b = rng.normal(size=n), rng.normal(size=m)
    got, path = warping._warp(a, b, r, True)
    assert got == pytest.approx(brute_dtw(a, b, r or 99))
    assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1)
    assert math.sqrt(sum((a[i] - b[j]) ** 2 for i, j in path)) == pytest.approx(got)
    assert warping._warp(b, a, r, False)[0] == pytest.approx(got)
    assert warping._warp(a, a, r, False)[0] == 0
    if r == 1:
        assert got == pytest.approx(np.linalg.norm(a - b))


def test_unit_root_properties():
    assert stationarity._p_value(-2.86, "c") == pytest.approx(0.05, abs=0.002)
    assert stationarity._p_value(-3.41, "ct") == pytest.approx(0.05, abs=0.002)
    rng = np.random.default_rng(5)
    noise = [stationarity._unit_root(rng.normal(size=200), "ct")[0] for _ in range(20)]
    walks = [stationarity._unit_root(np.cumsum(rng.normal(size=200)), "ct")[0] for _ in range(20)]
    assert max(noise) < 0.05 and np.mean(np.array(walks) > 0.05) > 0.8
    assert stationarity._unit_root(np.arange(4.0), "c")[1] == "数据不足"


def test_divergence_rules():
    flat = np.full(20, 2.0)
    assert lagged._divergence(flat, flat) == 0
    assert lagged._divergence(flat, flat + 1) == math.inf
    assert lagged._divergence(flat, np.arange(20.0)) == pytest.approx(0, abs=1e-9)
    x = np.random.default_rng(1).normal(size=100)
    assert lagged._divergence(x, x) == pytest.approx(0)
    assert lagged._divergence(x, x + 1) > 0


def test_lagged_correlation_finds_the_shift(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    y = np.roll(x, -3)  # y[t] = x[t + 3]
    rows = [("x", FRIDAYS[t], float(x[t])) for t in range(60)] + [("y", FRIDAYS[t], float(y[t])) for t in range(57)]
    rows += [("c", FRIDAYS[t], 1.0) for t in range(60)]
    obs = spark.createDataFrame(rows, "series string, d date, v double")
    got = lagged.lagged_correlation(obs, "x", 4)
    best = {r["candidate"]: (r["lag"], r["correlation"]) for r in rank.optimal_lag(got).collect()}
    assert best["y"] == (3, pytest.approx(1.0))
    assert "c" not in best


def test_ranks_match_pandas_under_heavy_ties(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "hot"], size=3000, p=[0.1, 0.1, 0.8]),
                        "x": np.where(rng.random(3000) < 0.4, 0.0, rng.normal(size=3000).round(2))})
    pdf.loc[::97, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double")
    got = rank.rank_descending(df, ["g"], F.col("x")).toPandas()
    want = got.groupby("g")["x"].rank(method="min", ascending=False)
    assert np.array_equal(got["rank"].fillna(-1).astype(int), want.fillna(-1).astype(int))
    whole = rank.rank_descending(df, [], F.col("x")).toPandas()
    assert np.array_equal(whole["rank"].fillna(-1).astype(int), whole["x"].rank(method="min", ascending=False).fillna(-1).astype(int))


def test_metrics_need_two_pairs(spark):
    now = spark.createDataFrame([("one", D(2024, 1, 26), 1.0), ("two", D(2024, 1, 26), 1.0), ("two", D(2024, 2, 23), 3.0)],
                                "model_id string, d date, v double")
    target = spark.createDataFrame([(m, D(2024, k, 28), float(k)) for m in ("one", "two") for k in (1, 2, 3)],
                                   "model_id string, d date, v double")
    got = {r["model_id"]: r for r in evaluation.metrics(now, target).collect()}
    assert got["one"]["rmse"] == math.inf and got["one"]["win_rate"] is None
    assert got["two"]["rmse"] == pytest.approx(math.sqrt(0.5)) and got["two"]["mae"] == pytest.approx(0.5)
    assert got["two"]["win_rate"] == pytest.approx(50.0)


def test_score_comparison(spark):
    cases = [((60, 1.0), (50, 0.5), 1), ((52, 1.0), (50, 0.5), -1), ((None, 1.0), (50, 2.0), -1), ((None, 1.0), (None, 2.0), 1),
             ((50, None), (50, 1.0), -1), ((50, 1.0), (50, 1.0), 0)]
    rows = [(*(None if x is None else float(x) for x in (*a, *b)), w) for a, b, w in cases]
    df = spark.createDataFrame(rows, "aw double, ar double, bw double, br double, want int")
    pair = lambda w, r: F.struct(F.col(w).alias("win_rate"), F.col(r).alias("rmse"))
    for r in df.withColumn("got", evaluation.compare_scores(pair("aw", "ar"), pair("bw", "br"))).collect():
        assert r["got"] == r["want"], r


def test_normalized_impacts_add_up(spark):
    rows = [("m", D(2024, 1, 1), D(2024, 1, d), v, 1.0, 0.5, 0.1, i, 1.0) for d, v, i in ((5, "a", 0.4), (12, "b", -0.1), (19, "a", 0.3))]
    imp = spark.createDataFrame(rows, "model_id string, month date, ts date, variable string, observed double, expected double, "
                                      "measurement_error double, impact double, gain_norm double")
    now = spark.createDataFrame([("m", D(2024, 1, 5), 1.0), ("m", D(2024, 1, 26), 4.0)], "model_id string, d date, v double")
    out, info = news.normalize(news.contributions(imp), now)
    assert out.agg(F.sum("impact")).first()[0] == pytest.approx(3.0)
    assert out.agg(F.sum("contribution_pct")).first()[0] == pytest.approx(100.0)
    assert info.first()["problem"] is None
    _, short = news.normalize(news.contributions(imp), now.limit(1))
    assert short.first()["problem"] == "too_few_nowcasts"


def test_names_match_by_containment(spark):
    w = spark.createDataFrame([("前:汽车制造业:后", 1), ("前:汽车制造业2:后", 0), ("煤炭开采和洗选业", 2)], "indicator string, pos int")
    names = spark.createDataFrame([("汽车制造业",), ("煤炭开采、洗选业",), ("没有",)], "industry string")
    got = {r["industry"]: r["indicator"] for r in match_names(names, w).collect()}
    assert got == {"汽车制造业": "前:汽车制造业2:后", "煤炭开采、洗选业": "煤炭开采和洗选业"}

"""Candidate sets that differ from a base by one variable; lag orders; subspace iteration."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dynamics, factor, selection, toggles

DAYS = [dt.date(2020, 1, 3) + dt.timedelta(days=7 * t) for t in range(60)]
TRAIN = DAYS[0].isoformat(), DAYS[44].isoformat()
NAMES = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    f = np.cumsum(rng.normal(size=(60, 2)), axis=0)
    x = f @ rng.normal(size=(2, 6)) + rng.normal(size=(60, 6)) + 3
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 5] = np.nan  # seen on too few dates for new loadings
    x[[3, 30, 50], 5] = [1.0, 2.0, 4.0]
    return x


def panel(spark, x, names=NAMES):
    rows = [(n, DAYS[t], None if np.isnan(x[t, i]) else float(x[t, i])) for i, n in enumerate(names) for t in range(len(x))]
    return spark.createDataFrame(rows, "variable string, d date, v double")


def by_set(df):
    return {r["candidate_id"]: r for r in df.groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("d", "f"))).alias("f"), F.first("rounds").alias("rounds"), F.first("converged").alias("done")).collect()}


@pytest.mark.parametrize("k, order", [(1, 1), (2, 2)])
def test_sets_equal_a_fit_per_set(spark, values, k, order):
    base, changes = NAMES[:4] + NAMES[5:], {"all": None, "without x1": "x1", "with x4": "x4"}
    p, few = panel(spark, values), toggles.Fit(k, order, max_iter=3)
    together = by_set(toggles.fit_sets(toggles.panel_rows(p, *TRAIN), base, changes, few))
    by_jobs = by_set(toggles.fit_sets(toggles.panel_rows(p.repartition(3), *TRAIN, panel_bytes=0), base, changes, few))
    for name, change in changes.items():
        chosen = set(base) ^ ({change} - {None})
        alone = factor.fit(p.filter(F.col("variable").isin(*chosen)).withColumn("model_id", F.lit("m")), k, *TRAIN, max_iter=3, order=order)
        want = alone["factors"].toPandas().pivot(index="d", columns="factor", values="v").sort_index().to_numpy()
        for got in (together, by_jobs):
            assert np.allclose([r["f"] for r in got[name]["f"]], want, rtol=1e-7, atol=1e-7)
            assert got[name]["rounds"] == 3 and not got[name]["done"]


def test_a_set_without_a_variable_is_the_total_minus_its_part(values):
    mu, sd = np.nanmean(values[:45], axis=0), np.nanstd(values[:45], axis=0, ddof=1)
    y = (values - mu).T
    rows = toggles.Rows(NAMES, y, np.nan_to_num(y[:, :45] / sd[:, None]), sd)
    train = np.arange(60) < 45
    fit = toggles.Fit(1)
    state = toggles._started(dynamics.leading(rows.z, 1), fit)
    everyone = frozenset(NAMES)
    total = toggles.set_parts(rows, train, state, toggles.members(NAMES, everyone, None))
    for v in NAMES:
        own = toggles.set_parts(rows, train, state, np.array([n == v for n in NAMES]))
        rest = toggles.set_parts(rows, train, state, toggles.members(NAMES, everyone, v))
        back = toggles.set_parts(rows, train, state, toggles.members(NAMES, everyone - {v}, v))
        for key in toggles.KEYS:
            assert np.allclose(total[key] - own[key], rest[key]) and np.allclose(total[key], back[key])


def test_rounds_stop_where_a_fit_stops(spark, values):
    p = panel(spark, values[:, :4], NAMES[:4])
    loose = toggles.Fit(1, tolerance=3.0)
    got = by_set(toggles.fit_sets(toggles.panel_rows(p, *TRAIN, panel_bytes=0), NAMES[:4], {"all": None, "less": "x0"}, loose))
    for name, chosen in (("all", NAMES[:4]), ("less", NAMES[1:4])):
        alone = factor.fit(p.filter(F.col("variable").isin(*chosen)).withColumn("model_id", F.lit("m")), 1, *TRAIN, tolerance=3.0)["log"].first()
        assert (got[name]["rounds"], got[name]["done"]) == (alone["rounds"], alone["converged"]) and alone["converged"]


def test_variables_must_have_the_same_dates(spark, values):
    with pytest.raises(ValueError, match="same dates"):
        toggles.panel_rows(panel(spark, values).filter("variable <> 'x1' OR d > '2020-02-01'"), *TRAIN)


def test_subspace_iteration_finds_the_leading_components(spark):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(80, 45)) @ np.diag(np.linspace(3, 1, 45))  # no gap to speak of
    x = np.vstack([z.T, rng.normal(size=(15, 80))])
    rows = toggles.panel_rows(panel(spark, x, [f"v{i}" for i in range(80)]), *TRAIN, panel_bytes=0)
    pdf = rows.rows.toPandas().sort_values("variable")
    scaled = np.array(list(pdf["z"]))
    got = toggles.leading_by_jobs(rows, list(pdf["variable"]), {"all": None, "less": "v7"}, 2)
    for f, keep in zip(got, (np.ones(80, bool), (pdf["variable"] != "v7").to_numpy())):
        values = np.linalg.svd(scaled[keep], compute_uv=False)[:2]
        assert np.allclose(np.linalg.norm(f, axis=0), values, rtol=1e-9)
        assert np.allclose(f, dynamics.leading(scaled[keep], 2), atol=1e-4)


def dense_filter(y, H, R, A, Q, x0, P0, k):
    """Filter, smoother and likelihood with full innovation matrices in the companion state."""
    T, m = len(y), len(A)
    xf, xp, Pf, Pp, ll = np.zeros((T, m)), np.zeros((T, m)), [P0] * T, [P0] * T, 0.0
    xf[0] = xp[0] = x0
    for t in range(1, T):
        xp[t], Pp[t] = A @ xf[t - 1], A @ Pf[t - 1] @ A.T + Q + 1e-6 * np.eye(m)
        ix = np.where(~np.isnan(y[t]))[0]
        if not len(ix):
            xf[t], Pf[t] = xp[t], Pp[t]
            continue
        h = np.hstack([H[ix], np.zeros((len(ix), m - k))])
        inn = y[t, ix] - h @ xp[t]
        S = h @ Pp[t] @ h.T + np.diag(R[ix])
        K = Pp[t] @ h.T @ np.linalg.inv(S + 1e-4 * np.eye(len(ix)))
        xf[t], P = xp[t] + K @ inn, (np.eye(m) - K @ h) @ Pp[t]
        Pf[t] = (P + P.T) / 2
        ll -= 0.5 * (len(ix) * math.log(2 * math.pi) + np.linalg.slogdet(S)[1] + inn @ np.linalg.solve(S, inn))
    xs = xf.copy()
    for t in range(T - 2, -1, -1):
        xs[t] = xf[t] + Pf[t] @ A.T @ np.linalg.inv(Pp[t + 1]) @ (xs[t + 1] - xp[t + 1])
    return xs[:, :k], xp[:, :k], ll


@pytest.mark.parametrize("k, order", [(1, 2), (2, 2), (2, 3)])
def test_lagged_factors_match_a_dense_filter(spark, values, k, order):
    x = values[:, :5]
    y = x - np.nanmean(x[:45], axis=0)
    sd = np.nanstd(x[:45], axis=0, ddof=1)
    z = np.nan_to_num(y[:45] / sd)
    f0 = dynamics.leading(z.T, k)
    ols = lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]
    seen = ~np.isnan(y[:45])
    H = np.array([ols(f0[seen[:, i]], y[:45, i][seen[:, i]]) for i in range(5)])
    R = np.maximum(np.var(z - f0 @ ols(f0, z), axis=0) * sd ** 2, 1e-6)
    stack = np.hstack([f0[order - i:45 - i] for i in range(1, order + 1)])
    A, Q = np.zeros((k * order, k * order)), np.zeros((k * order, k * order))
    A[k:, :-k] = np.eye(k * (order - 1))
    if k == 1:
        A[0], Q[0, 0] = 0.95 / order, 0.1
    else:
        X = np.column_stack([np.ones(45 - order), stack])
        beta = ols(X, f0[order:])
        A[:k], Q[:k, :k] = beta[1:].T, np.diag(np.diag(np.cov(f0[order:] - X @ beta, rowvar=False)))
    xs, xp, ll = dense_filter(y, H, R, A, Q, np.zeros(k * order), np.eye(k * order), k)
    got = factor.fit(panel(spark, x, NAMES[:5]).withColumn("model_id", F.lit("m")), k, *TRAIN, max_iter=1, order=order)
    table = lambda df, c: df.toPandas().pivot(index="d", columns="factor", values=c).sort_index().to_numpy()
    assert np.allclose(table(got["factors"], "v"), xs, atol=1e-6)
    assert np.allclose(table(got["predicted"], "state")[1:], xp[1:], atol=1e-6)
    assert got["log"].first()["loglik"] == pytest.approx(ll, abs=1e-5)


def test_next_dynamics_is_the_regression_on_all_lags():
    rng = np.random.default_rng(2)
    f = np.cumsum(rng.normal(size=(50, 2)), axis=0)
    a, q = dynamics.next_dynamics(f, 2)
    X = np.hstack([f[1:-1], f[:-2]])
    beta = np.linalg.lstsq(X, f[2:], rcond=None)[0]
    assert np.allclose(a[:2], beta.T, atol=1e-6) and np.allclose(a[2:], np.eye(4)[:2])
    e = f[2:] - X @ beta
    assert np.allclose(q[:2, :2], e.T @ e / 48, atol=1e-6) and not q[2:].any() and not q[:, 2:].any()


def plain_rounds(spark, frame, variables, s, step):
    """Selections with every candidate set written out and fitted as a model of its own."""
    def score(sets):
        rows = [(name, v) for name, vs in sets.items() for v in vs]
        scored = selection.evaluate_sets(frame, spark.createDataFrame(rows, "candidate_id string, variable string"), s)
        return {r["candidate_id"]: (r["score"]["win_rate"], r["score"]["rmse"]) for r in scored.collect()}
    if step == "backward":
        current, path = sorted(variables), []
        best = score({"all": current})["all"][1]
        while len(current) > 1:
            name, (_, rmse) = min(score({v: [c for c in current if c != v] for v in current}).items(), key=lambda x: (x[1][1], x[0]))
            if rmse > best:
                break
            current, best = [c for c in current if c != name], rmse
            path.append((name, round(rmse, 8)))
        return path
    return score({v: [v] for v in variables})


def test_backward_equals_rounds_of_separate_fits(spark, values):
    target = np.nanmean(values[:, :2], axis=1)
    frame = panel(spark, np.column_stack([values[:, :3], target]), NAMES[:3] + ["target"]).withColumnRenamed("variable", "series")
    s = selection.Setting("target", 1, *TRAIN, DAYS[45].isoformat(), DAYS[59].isoformat(), max_iter=1, mode="current_month", rule={"criterion": "rmse"})
    _, history = selection.backward(frame, NAMES[:3], s)
    got = [(r["variable"], round(r["rmse"], 8)) for r in history.collect() if r["action"] == "remove"]
    assert got == plain_rounds(spark, frame, NAMES[:3], s, "backward") and got
    single = {r["candidate_id"]: r["score"]["rmse"] for r in selection.change_one(frame, [], NAMES[:3], s, "add").collect()}
    want = plain_rounds(spark, frame, NAMES[:3], s, "add")
    assert {k: round(v, 8) for k, v in single.items()} == {k: round(v[1], 8) for k, v in want.items()}


def long_models(spark):
    """One model with few variables, one with few dates, standardised on all dates."""
    rng = np.random.default_rng(4)
    rows = [("tall", DAYS[t], f"v{i:02d}", float(rng.normal() + t * i / 50)) for i in range(6) for t in range(40)]
    rows += [("wide", DAYS[t], f"v{i:02d}", float(rng.normal() + t * i / 90)) for i in range(30) for t in range(12)]
    return spark.createDataFrame(rows, "model_id string, d date, variable string, v double")


def test_components_do_not_depend_on_the_side(spark, monkeypatch):
    p = long_models(spark)
    end = DAYS[39].isoformat()
    table = lambda df: df.toPandas().sort_values(["model_id", "component"]).reset_index(drop=True)
    want = table(factor.spectrum(p, TRAIN[0], end))
    factors = lambda: factor.static_factors(p, 2, TRAIN[0], end)[0].toPandas().sort_values(["model_id", "d"])
    f = np.stack(factors()["f"].to_numpy())
    assert list(want.groupby("model_id")["component"].max()) == [6, 12]
    assert np.allclose(want.groupby("model_id")["cumulative"].last(), 1.0)
    monkeypatch.setattr(factor, "FULL_SIDE", 3)
    monkeypatch.setattr(factor, "LEADING", 4)
    monkeypatch.setattr(toggles, "EXTRA", 2)
    few = table(factor.spectrum(p, TRAIN[0], end))
    both = want.merge(few, on=["model_id", "component"], suffixes=("", "_few"))
    assert len(both) == len(few) == 8
    for c in ("eigenvalue", "ratio", "cumulative", "n_variables"):
        assert np.allclose(both[c], both[f"{c}_few"], rtol=1e-9)
    assert np.allclose(np.stack(factors()["f"].to_numpy()), f, atol=1e-5)
    monkeypatch.setattr(factor, "FULL_SIDE", 2000)
    monkeypatch.setattr(factor, "HELD_BYTES", 1)  # sums handed on after every batch
    rows = p.filter("model_id = 'wide'")
    assert np.allclose(table(factor.spectrum(rows, TRAIN[0], end))["eigenvalue"], want[want["model_id"] == "wide"]["eigenvalue"])

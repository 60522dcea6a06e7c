"""Lags inside arrays, and warping paths in little memory."""

import datetime as dt
import math
import tracemalloc

import numpy as np
import pytest

from tidemark.operators import align, lagged, warping

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=t) for t in range(40)]


def table(spark, data):
    rows = [(n, DAYS[t], None if v is None else float(v)) for n, points in data.items() for t, v in points]
    return spark.createDataFrame(rows, "series string, d date, v double")


def test_correlations_by_position_at_every_lag(spark):
    rng = np.random.default_rng(1)
    x = list(enumerate(rng.normal(size=40)))
    data = {"x": [(t, None if t % 9 == 0 else v) for t, v in x], "y": [(t, v) for t, v in enumerate(rng.normal(size=40)) if t % 4],
            "constant": [(t, 2.0) for t in range(40)], "short": [(3, 1.0)], "empty": [(5, None)], "big": [(t, 1e9 + v) for t, v in x]}
    got = {(r.candidate, r.lag): r.correlation for r in lagged.lagged_correlation(table(spark, data), "x", 5).collect()}
    target = {t: v for t, v in data["x"] if v is not None}
    assert set(got) == {(n, k) for n in data if n != "x" for k in range(-5, 6)}
    for (name, k), value in got.items():
        pairs = [(target[t + k], v) for t, v in data[name] if v is not None and t + k in target]
        if len(pairs) < 2 or name == "constant":
            assert value is None
        else:
            assert value == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-6)
    plan = lagged.lagged_correlation(table(spark, data), "x", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_pairs_of_each_lag(spark):
    data = {"x": [(t, t) for t in range(6)], "y": [(10 + t, None if t == 2 else 10 * t) for t in range(4)], "one": [(1, 5.0)]}
    got = {(r.candidate, r.lag, r.px, r.py): (r.x, r.y) for r in align.lag_pairs(table(spark, data), "x", 2).collect()}
    want = {}
    for name in ("y", "one"):
        n = len(data[name])
        for k in range(-2, 3):
            for p in range(1, n + 1):
                if 1 <= p + k <= n and abs(k) < n:
                    y = data[name][p - 1][1]
                    want[name, k, p + k, p] = (float(p + k - 1), None if y is None else float(y))
    assert got == want


def whole_table(a, b, window):
    """Path with every move kept."""
    n, m = len(a), len(b)
    w = window or max(n, m)
    left, right = max(0, n - m) + w, max(0, m - n) + w
    c = np.full((n + 1, m + 1), math.inf)
    c[0, 0] = 0
    for i in range(n):
        for j in range(m):
            if i - left < j < i + right:
                c[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(c[i, j], c[i, j + 1], c[i + 1, j])
    if not np.isfinite(c[n, m]):
        return math.inf, None
    i, j, path = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        step = 2 if i == 0 else 1 if j == 0 else int(np.argmin([c[i, j], c[i, j + 1], c[i + 1, j]]))
        i, j = i - (step != 2), j - (step != 1)
        path.append((i, j))
    return math.sqrt(c[n, m]), path[::-1]


def test_paths_equal_those_of_the_whole_table():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (1, 7), (7, 1), (10, 10), (23, 17), (30, 41)):
        for window in (None, 1, 3):
            a, b = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, m).astype(float)  # many ties
            want, path = whole_table(a, b, window)
            got, way = warping._warp(a, b, window, True)
            assert (math.isinf(got) and math.isinf(want)) or got == pytest.approx(want)
            assert way == path


def test_long_paths_need_little_memory():
    rng = np.random.default_rng(7)
    a, b = np.cumsum(rng.normal(size=6000)), np.cumsum(rng.normal(size=6000))
    tracemalloc.start()
    distance, path = warping._warp(a, b, None, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert path[0] == (0, 0) and path[-1] == (5999, 5999) and peak < 20e6  # the table has 36 million moves
    assert distance == pytest.approx(math.sqrt(sum((a[i] - b[j]) ** 2 for i, j in path)))


def plain_weeks(rows, fridays, borrow=True):
    """Weeks of one series, each looked up on its own."""
    held = {f: sorted((d, v) for d, v in rows if v is not None and f - dt.timedelta(days=7) < d <= f) for f in fridays}
    out = {}
    for i, f in enumerate(fridays):
        ahead = held[fridays[i + 1]] if i + 1 < len(fridays) else []
        if held[f]:
            out[f] = held[f][-1][1], None
        else:
            out[f] = (ahead[0][1], ahead[0][0]) if borrow and len(ahead) >= 2 else (None, None)
    return out


@pytest.mark.parametrize("borrow", [True, False])
def test_weekly_alignment_equals_weeks_looked_up_one_by_one(spark, borrow):
    rng = np.random.default_rng(12)
    start, end = dt.date(2024, 1, 6), dt.date(2024, 4, 3)
    fridays = [d for d in (start + dt.timedelta(days=i) for i in range(89)) if d.weekday() == 4 and d <= end]
    every = [dt.date(2023, 12, 1) + dt.timedelta(days=int(i)) for i in range(180)]
    series = {f"s{k}": [(d, None if rng.random() < 0.3 else float(rng.normal())) for d in every if rng.random() < share]
              for k, share in enumerate((0.02, 0.05, 0.1, 0.2, 0.5, 0.1, 0.05))}
    series |= {"late": [(fridays[5], 1.0), (fridays[5] - dt.timedelta(days=1), 2.0)], "outside": [(every[0], 1.0), (every[-1], 2.0)], "nulls": [(fridays[2], None)]}
    frame = spark.createDataFrame([(n, d, v) for n, rows in series.items() for d, v in rows], "series string, d date, v double")
    got = {}
    for r in align.align_weekly(frame, start, end, borrow).collect():
        got.setdefault(r.series, {})[r.d] = (r.v, r.borrowed_from)
    assert got == {n: plain_weeks(rows, fridays, borrow) for n, rows in series.items() if rows}
    plan = align.align_weekly(frame, start, end)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan

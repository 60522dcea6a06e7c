"""Dynamic time warping of one target against many candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import arrays
from tidemark.operators.lagged import _scaled
from tidemark.session import spread

MIN_SAMPLES = 10


class _Table:
    """Anti-diagonals of the cost table of two samples.

    A window of r keeps shifts below r around the two corner diagonals, so 1
    is the point-by-point distance for equal lengths.  A diagonal is an array
    by row, whose slot i + 1 belongs to row i and slot 0 to the border above."""

    def __init__(self, a: np.ndarray, b: np.ndarray, window: int | None):
        self.a, self.back, self.n, self.m = a, b[::-1], len(a), len(b)
        w = window or max(self.n, self.m)
        self.left, self.right = max(0, self.n - self.m) + w - 1, max(0, self.m - self.n) + w - 1

    def border(self) -> np.ndarray:
        return np.full(self.n + 1, np.inf)

    def advance(self, k: int, older: np.ndarray, newer: np.ndarray, now: np.ndarray, moves: dict | None = None) -> None:
        """Fill diagonal ``k`` from the two before it, and note its moves."""
        lo, hi = max(0, k - self.m + 1, -((self.right - k) // 2)), min(self.n - 1, k, (k + self.left) // 2)
        now.fill(np.inf)
        if lo <= hi:
            gap = self.a[lo:hi + 1] - self.back[self.m - 1 - k + lo:self.m - k + hi]
            options = (older[lo:hi + 1], newer[lo:hi + 1], newer[lo + 1:hi + 2])
            best = np.minimum(np.minimum(options[0], options[1]), options[2]) if k else 0.0
            now[lo + 1:hi + 2] = gap * gap + best
            if moves is not None:
                moves[k] = lo, np.argmin(np.stack(options), axis=0).astype(np.int8)


def _warp(a: np.ndarray, b: np.ndarray, window: int | None, want_path: bool):
    """Distance, and optionally the path.

    For a path every so many diagonals are kept, about the square root of their
    number; the moves between two kept ones are computed again on the way back
    and dropped, so that memory does not grow with the product of the lengths."""
    table = _Table(a, b, window)
    last = table.n + table.m - 2
    every = max(1, int(np.sqrt(last + 1)))
    older, newer, now = (table.border() for _ in range(3))
    kept = {}
    for k in range(last + 1):
        if want_path and k % every == 0:
            kept[k] = older.copy(), newer.copy()
        table.advance(k, older, newer, now)
        older, newer, now = newer, now, older
    distance = float(np.sqrt(newer[table.n]))
    if not want_path or not np.isfinite(distance):
        return distance, None
    i, j, path = table.n - 1, table.m - 1, [(table.n - 1, table.m - 1)]
    for first in sorted(kept, reverse=True):
        moves: dict = {}
        (older, newer), now = kept.pop(first), table.border()
        for k in range(first, min(first + every, last + 1)):
            table.advance(k, older, newer, now, moves)
            older, newer, now = newer, now, older
        while i + j >= first and (i > 0 or j > 0):
            lo, of = moves[i + j]
            step = 2 if i == 0 else 1 if j == 0 else of[i - lo]
            i, j = i - (step != 2), j - (step != 1)
            path.append((i, j))
    return distance, path[::-1]


def _distance_udf(window: int | None, method: str):
    @F.pandas_udf(T.DoubleType())
    def run(targets: pd.Series, candidates: pd.Series) -> pd.Series:
        def one(t, c):
            d, _ = _warp(_scaled(np.asarray(t, float), method), _scaled(np.asarray(c, float), method), window, False)
            return d if np.isfinite(d) else None
        return pd.Series([None if t is None or c is None else one(t, c) for t, c in zip(targets, candidates)], dtype="float64")
    return run


def _path_udf(window: int | None, method: str):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def run(targets: pd.Series, candidates: pd.Series) -> pd.Series:
        def one(t, c):
            _, p = _warp(_scaled(np.asarray(t, float), method), _scaled(np.asarray(c, float), method), window, True)
            return [[int(i), int(j)] for i, j in p] if p else []
        return pd.Series([one(t, c) for t, c in zip(targets, candidates)])
    return run


def _pairs(obs: DataFrame, target: str, strict: bool) -> DataFrame:
    """Candidate and target values to compare, as two arrays per candidate."""
    seen = obs.filter(F.col("v").isNotNull())
    others = spread(seen.filter(F.col("series") != target), "series")
    fit = (F.count("v") >= MIN_SAMPLES) & (F.min("v") < F.max("v"))
    if strict:
        # One target row per date: bounded by the calendar, whatever the raw rows.
        t = seen.filter(F.col("series") == target).groupBy("d").agg(F.max("v").alias("tv"))
        both = F.collect_list(F.when(F.col("tv").isNotNull(), F.struct("d", "v", "tv")))
        c = others.join(t, "d", "left").groupBy("series").agg(fit.alias("valid"), F.array_sort(both).alias("a"))
        return c.select("series", "valid", F.lit(True).alias("overlap"), F.transform("a", lambda x: x["v"]).alias("c"),
                        F.transform("a", lambda x: x["tv"]).alias("t"))
    c = others.groupBy("series").agg(fit.alias("valid"), arrays.dated().alias("c")).withColumn("t", arrays.target_array(obs, target))
    last = lambda a: F.get(F.col(a), F.size(a) - 1)["d"]
    ranged = c.withColumn("lo", F.greatest(F.get("c", F.lit(0))["d"], F.get("t", F.lit(0))["d"])).withColumn(
        "hi", F.least(last("c"), last("t")))
    cut = lambda a: F.transform(F.filter(a, lambda x: x["d"].between(F.col("lo"), F.col("hi"))), lambda x: x["v"])
    return ranged.select("series", "valid", F.coalesce(F.col("lo") <= F.col("hi"), F.lit(False)).alias("overlap"),
                         cut("c").alias("c"), cut("t").alias("t"))


def warp_candidates(obs: DataFrame, target: str, radius: int | None = None, strict: bool = True,
                    method: str = "zscore") -> DataFrame:
    """Warping distance of each candidate, or the reason it has none.

    Candidates are independent rows: Spark spreads them, numpy fills each
    table.  Strict pairing keeps common dates, loose pairing the common range;
    both sides are then standardised on what was kept."""
    pairs = _pairs(obs, target, strict)
    nt, nc = F.size("t"), F.size("c")
    reason = (F.when(~F.col("valid"), "对比序列无效").when(~F.col("overlap"), "时间范围无重叠")
              .when(nt < MIN_SAMPLES, F.concat(F.lit("目标序列样本不足: "), nt.cast("string")))
              .when(nc < MIN_SAMPLES, F.concat(F.lit("对比序列样本不足: "), nc.cast("string"))))
    if radius is not None:
        gap = F.abs(nt - nc)
        reason = F.coalesce(reason, F.when(gap > radius, F.concat(
            F.lit("长度差异("), gap.cast("string"), F.lit(f") > radius({radius})"))))
    judged = pairs.withColumn("reason", reason).withColumn("n", F.least(nt, nc))
    run = _distance_udf(radius, method)
    ok = F.col("reason").isNull()
    return judged.select(F.col("series").alias("candidate"), "n", run(
        F.when(ok, F.col("t")), F.when(ok, F.col("c"))).alias("distance"), "reason")


def warp_paths(obs: DataFrame, target: str, radius: int | None = None, strict: bool = True,
               method: str = "zscore") -> DataFrame:
    """Alignment steps ``(candidate, step, target_pos, candidate_pos)``."""
    good = _pairs(obs, target, strict).filter(
        F.col("valid") & F.col("overlap") & (F.size("t") >= MIN_SAMPLES) & (F.size("c") >= MIN_SAMPLES))
    if radius is not None:
        good = good.filter(F.abs(F.size("t") - F.size("c")) <= radius)
    paths = good.select("series", F.posexplode(_path_udf(radius, method)("t", "c")).alias("step", "at"))
    return paths.select(F.col("series").alias("candidate"), "step", F.col("at")[0].alias("target_pos"),
                        F.col("at")[1].alias("candidate_pos"))


def rank_by_distance(distances: DataFrame, paths: DataFrame) -> DataFrame:
    """Candidates by distance per path step, closest first, failures last."""
    steps = paths.groupBy("candidate").agg(F.count(F.lit(1)).alias("path_length"))
    return (distances.join(steps, "candidate", "left")
            .withColumn("normalized", F.try_divide("distance", "path_length"))
            .orderBy(F.col("normalized").asc_nulls_last(), "candidate"))

"""Lagged correlation and distribution-divergence lead/lag screening."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.functions.numeric import histogram_bins
from tidemark.operators import arrays

MIN_KL_SAMPLES = 10
BEST_LAG_RANGE = 5


def lagged_correlation(obs: DataFrame, target: str, max_lag: int = 12) -> DataFrame:
    """Pearson correlation of every candidate with the target at each lag.

    Positions are those of the whole frame's dates; pairs are made by position
    first and dropped when either side is missing.  ``correlation`` at lag k
    pairs target[t + k] with candidate[t] and is null for under two pairs or a
    constant side.

    The frame and the target on it, bounded by the calendar, are one broadcast
    variable.  A candidate is one dated array, grouped by series, and all lags
    are taken inside it, so that rows are neither joined on dates nor repeated
    per lag."""
    frame = obs.groupBy("d").agg(F.max(F.when(F.col("series") == target, F.col("v"))).alias("x")).orderBy("d").toPandas()
    days = frame["d"].to_numpy("datetime64[D]").astype(np.int64)
    edge = np.full(max_lag, np.nan)
    shared = obs.sparkSession.sparkContext.broadcast((days, np.concatenate((edge, frame["x"].to_numpy(float), edge))))
    point = F.when(F.col("v").isNotNull(), F.struct(F.unix_date("d").alias("day"), F.col("v").cast("double").alias("v")))
    candidates = obs.filter(F.col("series") != target).groupBy("series").agg(F.collect_list(point).alias("points"))
    points = candidates.select("series", F.transform("points", lambda p: p["day"]).alias("days"), F.transform("points", lambda p: p["v"]).alias("values"))
    lags = np.arange(-max_lag, max_lag + 1)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(dates: pd.Series, values: pd.Series) -> pd.Series:
        calendar, x = shared.value
        out = []
        for d, v in zip(dates, values):
            at = np.searchsorted(calendar, np.asarray(d, np.int64))
            out.append(correlations(x[at[:, None] + max_lag + lags], np.asarray(v, float)))
        return pd.Series(out)

    scored = points.select("series", F.posexplode(run("days", "values")).alias("i", "correlation"))
    return scored.select(F.col("series").alias("candidate"), (F.col("i") - max_lag).alias("lag"), "correlation")


def correlations(x: np.ndarray, y: np.ndarray) -> list[float | None]:
    """Correlation of ``y`` with each column of ``x`` over the rows where it is not NaN."""
    seen = ~np.isnan(x)
    n = seen.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = lambda m: np.where(seen, m - np.where(seen, m, 0.0).sum(axis=0) / n, 0.0)
        a, b = centre(x), centre(np.broadcast_to(y[:, None], x.shape))
        out = (a * b).sum(axis=0) / np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0))
    spread = lambda m: np.where(seen, m, -np.inf).max(axis=0, initial=-np.inf) > np.where(seen, m, np.inf).min(axis=0, initial=np.inf)
    fit = (n >= 2) & spread(x) & spread(np.broadcast_to(y[:, None], x.shape)) & np.isfinite(out)
    return [float(c) if ok else None for c, ok in zip(out, fit)]


def _divergence(a: np.ndarray, b: np.ndarray) -> float:
    """Smoothed Kullback-Leibler divergence of two samples on shared bins."""
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    flat_a, flat_b = a.min() == a.max(), b.min() == b.max()
    if flat_a and flat_b:
        return 0.0 if a[0] == b[0] else math.inf
    n = min(len(a), len(b))
    bins = 1 if flat_a or flat_b else max(2, math.ceil(min(math.sqrt(n), 10 * math.log10(n))))
    edges = np.linspace(lo, hi, bins + 1)
    p, q = (np.histogram(s, bins=edges)[0] / len(s) + vocab.KL_SMOOTHING for s in (a, b))
    p, q = p / p.sum(), q / q.sum()
    return max(0.0, float(np.sum(p * (np.log(p) - np.log(q)))))


def _scaled(a: np.ndarray, method: str) -> np.ndarray:
    if method == "zscore":
        spread = a.std(ddof=1)
        return a if not spread > 0 else (a - a.mean()) / spread
    if method == "minmax":
        return a if a.max() == a.min() else (a - a.min()) / (a.max() - a.min())
    return a


def divergence_udf(target, max_lag: int, method: str, min_length: int):
    """Arrow helper: divergence of the target, a broadcast variable, and a
    candidate at every lag."""
    lags = range(-max_lag, max_lag + 1)

    def pair(t, c):
        t, c = np.asarray(t, dtype=float), np.asarray(c, dtype=float)
        n = min(len(t), len(c))
        if n < min_length:
            return [None] * len(lags)
        t, c = _scaled(t, method), _scaled(c, method)
        out = []
        for k in lags:
            a, b = (t[k:n], c[:n - k]) if k >= 0 else (t[:n + k], c[-k:n])
            kl = _divergence(a, b) if len(a) >= MIN_KL_SAMPLES else math.nan
            out.append(kl if math.isfinite(kl) else None)
        return out

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(candidates: pd.Series) -> pd.Series:
        return pd.Series([pair(target.value, c) for c in candidates])

    return run


def lagged_divergence(obs: DataFrame, target: str, max_lag: int = 12, method: str = "zscore") -> DataFrame:
    """Divergence of candidate from target at each lag.

    Nulls leave each series before pairing and the series are standardised
    once over their full length; fewer than ``max_lag + 10`` values give null.
    One shuffle collects each candidate as an array; lags are cut inside it."""
    candidates = arrays.series_arrays(obs.filter(F.col("series") != target))
    t = obs.sparkSession.sparkContext.broadcast(arrays.target_sample(obs, target))
    run = divergence_udf(t, max_lag, method, max_lag + MIN_KL_SAMPLES)
    scored = candidates.select("series", F.posexplode(run("values")).alias("i", "kl"))
    return scored.select(F.col("series").alias("candidate"), (F.col("i") - max_lag).alias("lag"), "kl")


def best_divergence(by_lag: DataFrame, within: int = BEST_LAG_RANGE) -> DataFrame:
    """Lag of least divergence within ``±within``; smallest lag on ties."""
    best = F.min(F.when(F.col("kl").isNotNull() & (F.abs("lag") <= within), F.struct("kl", "lag")))
    return by_lag.groupBy("candidate").agg(best.alias("b")).select("candidate", "b.lag", "b.kl")


def divergence(obs: DataFrame, target: str) -> DataFrame:
    """Divergence of every candidate from the target without lag or scaling.

    ``status`` tells apart short samples and different constants."""
    t = obs.sparkSession.sparkContext.broadcast(arrays.target_sample(obs, target))
    both = arrays.series_arrays(obs.filter(F.col("series") != target))
    n = F.least(F.size("values"), F.lit(len(t.value)))
    enough = n >= F.greatest(histogram_bins(n) * 2, F.lit(MIN_KL_SAMPLES))
    kl = divergence_udf(t, 0, "none", 1)(F.col("values"))[0]
    return both.select(F.col("series").alias("candidate"), F.when(enough, kl).alias("kl"), (
        F.when(~enough, "insufficient_data").when(kl.isNull(), "different_constants").otherwise("ok")).alias("status"))


def lead_lag(obs: DataFrame, target: str, max_lag: int = 12, method: str = "zscore",
             align_frequencies: bool = True) -> DataFrame:
    """Screen every candidate: unify frequencies, score lags, keep the best,
    least divergence first and failures last."""
    from tidemark.operators.align import unify_frequencies
    ready = unify_frequencies(obs) if align_frequencies else obs
    best = best_divergence(lagged_divergence(ready, target, max_lag, method))
    return best.orderBy(F.col("kl").asc_nulls_last(), "candidate")

"""Numeric helpers of the dynamic factor model, on arrays of one model.

``order`` autoregressive lags are a companion state: the last ``order`` factor
vectors one below the other, of which the first is observed."""

from __future__ import annotations

import numpy as np

# Starting dynamics of one factor and numerical floors.
FIRST_AR = 0.95
FIRST_Q = 0.1
MIN_VARIANCE = 1e-6
MIN_EIGENVALUE = 1e-7
GAIN_JITTER = 1e-4


def lagged(f: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor vectors from the ``order``-th on, and the ``order`` before each, latest first."""
    return f[order:], np.hstack([f[order - i:len(f) - i] for i in range(1, order + 1)])


def companion(coefficients: np.ndarray, shocks: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    k = len(coefficients)
    a, q = np.zeros((k * order, k * order)), np.zeros((k * order, k * order))
    a[:k], q[:k, :k] = coefficients, shocks
    a[k:, :-k] = np.eye(k * (order - 1))
    return a, q


def first_dynamics(f: np.ndarray, order: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Starting transition and shock covariance: a regression on ``order`` lags
    with intercept, or fixed values for a single factor."""
    k = f.shape[1]
    if k == 1:
        return companion(np.full((1, order), FIRST_AR / order), np.array([[FIRST_Q]]), order)
    y, x = lagged(f, order)
    x = np.column_stack([np.ones(len(x)), x])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    spread = np.maximum(np.diag(np.cov(y - x @ beta, rowvar=False)), MIN_VARIANCE)
    return companion(beta[1:].T, np.diag(spread), order)


def next_dynamics(f: np.ndarray, order: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Transition and shock covariance from smoothed factors, without intercept."""
    y, x = lagged(f, order)
    k, moment = f.shape[1], x.T @ x
    a = np.linalg.solve((moment + np.eye(len(moment)) * MIN_EIGENVALUE).T, (y.T @ x).T).T
    shock = (y.T @ y - a @ moment @ a.T) / len(y)
    values, vecs = np.linalg.eigh((shock + shock.T) / 2)
    return companion(a, vecs @ np.diag(np.maximum(values, MIN_EIGENVALUE)) @ vecs.T, order)


def recursion(info: dict[str, np.ndarray], a, q, x0, p0, last, done: bool, k: int, order: int = 1, tolerance: float = 1e-6) -> dict:
    """Filter and smoother over one model's dates and the next dynamics.

    ``info`` holds for every date the number of observations ``n`` and what they
    say of the factors: ``c`` (dates, k, k) and ``b`` (dates, k) for gains,
    ``c0``, ``b0``, ``s0`` and ``ld`` for the likelihood.  The first date has no
    update.  A model that is done, or whose likelihood moved less than the
    tolerance, keeps its dynamics."""
    m, size = k * order, len(info["n"])
    eye = np.eye(m)
    C, C0 = np.zeros((size, m, m)), np.zeros((size, m, m))
    b, b0 = np.zeros((size, m)), np.zeros((size, m))
    C[:, :k, :k], C0[:, :k, :k], b[:, :k], b0[:, :k] = info["c"], info["c0"], info["b"], info["b0"]
    n, s0, ld = info["n"], info["s0"], info["ld"]
    xf, xp, Pf, Pp = np.zeros((size, m)), np.zeros((size, m)), np.zeros((size, m, m)), np.zeros((size, m, m))
    xf[0] = xp[0] = x0
    Pf[0] = Pp[0] = p0
    loglik = 0.0
    for t in range(1, size):
        x, P = a @ xf[t - 1], a @ Pf[t - 1] @ a.T + q + eye * MIN_VARIANCE
        xp[t], Pp[t] = x, P
        if n[t] == 0:
            xf[t], Pf[t] = x, P
            continue
        Pt = P @ np.linalg.inv(eye + C[t] @ P)
        Pf[t] = (Pt + Pt.T) / 2
        xf[t] = x + Pf[t] @ (b[t] - C[t] @ x)
        u = b0[t] - C0[t] @ x
        M = eye + C0[t] @ P
        fit = s0[t] - 2 * x @ b0[t] + x @ C0[t] @ x - u @ P @ np.linalg.solve(M, u)
        loglik -= 0.5 * (n[t] * np.log(2 * np.pi) + ld[t] + np.linalg.slogdet(M)[1] + fit)
    xs, Ps = xf.copy(), Pf.copy()
    for t in range(size - 2, -1, -1):
        J = np.linalg.solve(Pp[t + 1].T, a @ Pf[t].T).T
        xs[t] = xf[t] + J @ (xs[t + 1] - xp[t + 1])
        Ps[t] = Pf[t] + J @ (Ps[t + 1] - Pp[t + 1]) @ J.T
    done = done or (last is not None and np.isfinite(last) and abs(loglik - last) < tolerance)
    if not done:
        a, q = next_dynamics(xs[:, :k], order)
        x0, p0 = xs[0], Ps[0]
    return {"f": xs[:, :k], "xp": xp[:, :k], "pf": Pf[:, :k, :k], "a": a, "q": q, "x0": x0, "p0": p0, "last": loglik, "done": done}


def regress_rows(y: np.ndarray, f: np.ndarray, min_extra: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """No-intercept regression of every row of ``y`` (NaN missing) on the
    factors: coefficients and residual variance, NaN with too few dates."""
    k, seen = f.shape[1], ~np.isnan(y)
    y0, n = np.where(seen, y, 0.0), seen.sum(axis=1)
    w = seen.astype(float)
    gram = (w @ (f[:, :, None] * f[:, None, :]).reshape(len(f), -1)).reshape(-1, k, k)
    moment = y0 @ f
    h = (np.linalg.pinv(gram) @ moment[:, :, None])[:, :, 0]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (y0.sum(axis=1) - (h * (w @ f)).sum(axis=1)) / n
        variance = ((y0 * y0).sum(axis=1) - 2 * (h * moment).sum(axis=1) + np.einsum("vi,vij,vj->v", h, gram, h)) / n - mean * mean
    enough = n >= k + min_extra
    return np.where(enough[:, None], h, np.nan), np.where(enough, np.maximum(variance, 0.0), np.nan)


def first_parameters(z: np.ndarray, y: np.ndarray, sigma: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loadings on centred values and error variances, from initial factors on
    the training dates; ``z`` standardised without gaps, ``y`` centred."""
    w, psi = regress_rows(z, f)
    h, _ = regress_rows(y, f)
    return np.where(np.isnan(h), w, h), np.fmax(psi * sigma * sigma, MIN_VARIANCE)


def later_parameters(y: np.ndarray, f: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and variances from smoothed factors; rows with too few dates keep ``h`` and ``r``."""
    new, variance = regress_rows(y, f)
    moved = ~np.isnan(new[:, 0])
    return np.where(moved[:, None], new, h), np.where(moved, np.maximum(variance, MIN_EIGENVALUE), r)


def information(y: np.ndarray, h: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """What each date's observations say about the factors, summed over the rows of ``y``."""
    k, seen = h.shape[1], ~np.isnan(y)
    known = seen & ~np.isnan(h[:, :1]) & ~np.isnan(r)[:, None]
    h, r = np.nan_to_num(h), np.where(np.isnan(r), 1.0, r)
    w, y0 = known.T.astype(float), np.where(known, y, 0.0).T
    outer = (h[:, :, None] * h[:, None, :]).reshape(len(h), -1)
    grid = lambda v: (w @ (outer / v[:, None])).reshape(-1, k, k)
    line = lambda v: y0 @ (h / v[:, None])
    soft = r + GAIN_JITTER
    return {"n": seen.sum(axis=0).astype(float), "c": grid(soft), "b": line(soft), "c0": grid(r), "b0": line(r),
            "s0": (y0 * y0) @ (1 / r), "ld": w @ np.log(r)}


def oriented(f: np.ndarray) -> np.ndarray:
    """Columns with their largest entry, in absolute terms, positive."""
    sign = np.sign(f[np.abs(f).argmax(axis=0), np.arange(f.shape[1])])
    return f * np.where(sign == 0, 1.0, sign)


def leading(z: np.ndarray, k: int) -> np.ndarray:
    """Leading date vectors times singular values of rows ``z``, by the smaller side."""
    if len(z) <= z.shape[1]:
        values, vecs = np.linalg.eigh(z @ z.T)
        return oriented(z.T @ vecs[:, ::-1][:, :k])
    values, vecs = np.linalg.eigh(z.T @ z)
    return oriented(vecs[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0.0)))

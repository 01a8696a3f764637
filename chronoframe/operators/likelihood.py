"""Exact Gaussian likelihood of ARIMA models over one series of any length.

The Kalman filter's gains do not depend on the data and settle after some steps,
so they are computed once.  With them the filter is linear in the state at a
block's start and in the data: a block's innovations are an affine function of
that state, and everything the likelihood needs of the block is one small
quadratic form (``Q``) and the map of its start to its end (``M``).  Two
neighbouring blocks combine into one such pair, so blocks are filtered
independently, and the pairs are combined a fixed number at a time.  All
parameter vectors of an optimisation step (a gradient's differences, a line
search's steps) go through the same pass over the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import block_size, cut_lineage
from .linear import arima_fit
from .validate import complete, require

RUN = 256                                       # rows of a block that are filtered one after another
GROUP = 256                                     # blocks whose forms are combined in one task
LONGEST = 20_000                                # steps until the gains are taken as settled
EDGE = 0.9995                                   # largest partial autocorrelation
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def from_partial(pac: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression with these partial autocorrelations."""
    phi = np.zeros(0)
    for r in pac:
        phi = np.append(phi - r * phi[::-1], r)
    return phi


def to_partial(phi: np.ndarray) -> np.ndarray:
    phi, out = np.array(phi, float), []
    while len(phi):
        r = float(np.clip(phi[-1], -EDGE, EDGE))
        out.append(r)
        phi = (phi[:-1] + r * phi[:-1][::-1]) / (1 - r * r)
    return np.array(out[::-1])


class Model:
    """State space form of an ARMA(p, q) with unit innovation variance, and the
    filter's gains from the stationary start until they settle."""

    def __init__(self, phi: np.ndarray, theta: np.ndarray, n: int):
        r = max(len(phi), len(theta) + 1)
        self.T = np.zeros((r, r))
        self.T[:len(phi), 0] = phi
        self.T[np.arange(r - 1), np.arange(1, r)] = 1.0
        R = np.zeros(r)
        R[0], R[1:1 + len(theta)] = 1.0, theta
        noise = np.outer(R, R)
        P = np.linalg.solve(np.eye(r * r) - np.kron(self.T, self.T), noise.ravel()).reshape(r, r)
        gains, variances = [], []
        for _ in range(min(n, LONGEST)):
            f = P[0, 0]
            k = self.T @ P[:, 0] / f
            gains.append(k), variances.append(f)
            nxt = self.T @ P @ self.T.T + noise - f * np.outer(k, k)
            if np.abs(nxt - P).max() <= 1e-15 * np.abs(P).max():
                break
            P = nxt
        self.K, self.F = np.array(gains), np.array(variances)
        held = max(n - len(self.F), 0)
        self.log_f = float(np.log(self.F).sum() + held * math.log(self.F[-1]))

    def forms(self, y: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """(Q, M) of the rows ``start``, ``start`` + 1, ...: over u = (state at
        the start, weight of the data, weight of a constant 1), the innovations'
        sum of squares is u Q u, and the state after the last row is M u."""
        r = len(self.T)
        runs = -(-len(y) // RUN)
        padded = np.zeros(runs * RUN)
        padded[:len(y)] = y
        data = padded.reshape(runs, RUN)
        M = np.zeros((runs, r, r + 2))
        M[:, np.arange(r), np.arange(r)] = 1.0
        Q = np.zeros((runs, r + 2, r + 2))
        first = start + np.arange(runs) * RUN
        for t in range(RUN):
            live = np.arange(runs) * RUN + t < len(y)
            at = np.minimum(first + t, len(self.F) - 1)
            v = -M[:, 0, :]
            v[:, r] += data[:, t]
            v[:, r + 1] += 1.0
            w = v * np.where(live, 1.0 / self.F[at], 0.0)[:, None]
            Q += w[:, :, None] * v[:, None, :]
            M = np.where(live[:, None, None], self.T @ M + self.K[at][:, :, None] * v[:, None, :], M)
        return chained(Q, M)


def chained(Q: np.ndarray, M: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and M of consecutive runs as one, neighbours first."""
    r = M.shape[1]
    while len(Q) > 1:
        even = len(Q) // 2 * 2
        W = np.zeros((even // 2, r + 2, r + 2))
        W[:, :r], W[:, r, r], W[:, r + 1, r + 1] = M[:even:2], 1.0, 1.0
        q = Q[:even:2] + W.transpose(0, 2, 1) @ Q[1:even:2] @ W
        Q, M = np.concatenate([q, Q[even:]]), np.concatenate([M[1:even:2] @ W, M[even:]])
    return Q[0], M[0]


def log_likelihood(Q: np.ndarray, log_f: float, n: int, constant: bool) -> tuple[float, float, float]:
    """(log-likelihood, innovation variance, mean) at their best variance and mean."""
    yy, yc, cc = Q[-2, -2], Q[-2, -1], Q[-1, -1]
    mean = yc / cc if constant else 0.0
    sigma2 = max(yy - 2 * mean * yc + mean * mean * cc, 1e-300) / n
    return -0.5 * (n * (math.log(2 * math.pi) + math.log(sigma2) + 1.0) + log_f), sigma2, mean


def evaluate(blocks: DataFrame, models: list[Model], idx: str, value: str, group: int = GROUP) -> list[np.ndarray]:
    """Q of every model over a series dealt into blocks (``_blk``), in one pass."""
    def run(pdf):
        pdf = pdf.sort_values(idx)
        y, start = pdf[value].to_numpy(float), int(pdf[idx].iloc[0])
        forms = [m.forms(y, start) for m in models]
        return pd.DataFrame({"_blk": int(pdf["_blk"].iloc[0]), "_m": range(len(models)), "_q": [q.ravel().tolist() for q, _ in forms],
                             "_s": [s.ravel().tolist() for _, s in forms]})

    def join(pdf):
        pdf = pdf.sort_values("_blk")
        r = len(models[int(pdf["_m"].iloc[0])].T)
        q, s = chained(np.stack(pdf["_q"]).reshape(-1, r + 2, r + 2), np.stack(pdf["_s"]).reshape(-1, r, r + 2))
        return pd.DataFrame({"_blk": [int(pdf["_g"].iloc[0])], "_m": [int(pdf["_m"].iloc[0])], "_q": [q.ravel().tolist()], "_s": [s.ravel().tolist()]})

    schema = "_blk long, _m int, _q array<double>, _s array<double>"
    parts = cut_lineage(blocks.groupBy("_blk").applyInPandas(run, schema))
    most = parts.agg(F.max("_blk")).first()[0] + 1
    while most > 1:                             # forms of forms
        parts = cut_lineage(parts.withColumn("_g", F.floor(F.col("_blk") / group)).groupBy("_g", "_m").applyInPandas(join, schema))
        most = -(-most // group)
    out = {r["_m"]: np.array(r["_q"]).reshape(len(models[r["_m"]].T) + 2, -1) for r in parts.collect()}    # one form per model
    return [out[k] for k in range(len(models))]


def arima_mle(long_y: DataFrame, p: int, d: int, q: int, idx: str = "idx", value: str = "value", trend: str | None = None,
              max_iter: int = 30, tol: float = 1e-7, size: int | None = None, group: int = GROUP) -> DataFrame:
    """ARIMA(p, d, q) by exact maximum likelihood of the ``d``-times
    differenced series from its stationary distribution.  Starts from the two
    regressions of :func:`linear.arima_fit` and climbs by BFGS, with a pass over
    the data for a gradient and one for a line search.  Coefficients stay inside
    the stationary and invertible region.  ``trend`` 'c' has a mean and 'n' none;
    by default there is one only without differencing.

    Output: term, coef for mean, ar<k>, ma<k>, sigma2, llf, aic, aicc, bic, nobs.
    One series with positions 0, 1, ...; missing values are refused."""
    from .transform import difference
    require(p >= 0 and q >= 0 and d >= 0, "orders must be >= 0")
    require(trend in (None, "c", "n"), "trend must be 'c' or 'n'")
    constant = d == 0 if trend is None else trend == "c"
    size = block_size(long_y.sparkSession, size)
    y = long_y.select(F.col(idx).cast("long").alias(idx), complete(F.col(value), "the likelihood").alias(value))
    if d:
        y = difference(y, [value], order=d, idx=idx, check=False)
    first = y.agg(F.min(idx)).first()[0] or 0
    blocks = cut_lineage(y.select((F.col(idx) - first).alias(idx), value).withColumn("_blk", F.floor(F.col(idx) / size)).repartition("_blk"))
    n = blocks.count()
    require(n > p + q + 2, "the series is too short for the model")

    def models(points):
        return [Model(from_partial(EDGE * np.tanh(x[:p])), -from_partial(EDGE * np.tanh(x[p:])), n) for x in points]

    def values(points):
        built = models(points)
        return [log_likelihood(Q, m.log_f, n, constant) for Q, m in zip(evaluate(blocks, built, idx, value, group), built)]

    x = np.zeros(p + q)
    if p + q:
        start = {r["term"]: r["coef"] for r in arima_fit(blocks.select(idx, value), p, 0, q, idx, value, trend="c" if constant else "n").collect()}
        ar, ma = (np.array([start[f"{name}{k}"] for k in range(1, m + 1)]) for name, m in (("ar", p), ("ma", q)))
        x = np.arctanh(np.clip(np.concatenate([to_partial(ar), to_partial(-ma)]) / EDGE, -0.99, 0.99))
    best, H, eps = values([x])[0], np.eye(p + q) / n, 1e-4
    g = None
    for _ in range(max_iter if p + q else 0):
        around = values([x + s * eps * e for e in np.eye(p + q) for s in (1, -1)])
        new = np.array([(a[0] - b[0]) / (2 * eps) for a, b in zip(around[::2], around[1::2])])
        if g is not None:                       # curvature from the last step
            dg = g - new
            if (sy := float(step @ dg)) > 1e-12:
                left = np.eye(p + q) - np.outer(step, dg) / sy
                H = left @ H @ left.T + np.outer(step, step) / sy
        else:                                   # curvature of each coordinate from the same differences
            second = np.array([(2 * best[0] - a[0] - b[0]) / eps ** 2 for a, b in zip(around[::2], around[1::2])])
            H = np.diag(1.0 / np.maximum(second, 1e-3 * n))
        g = new
        direction = H @ g
        tried = values([x + s * direction for s in STEPS])
        k = max(range(len(STEPS)), key=lambda i: tried[i][0])
        if tried[k][0] <= best[0] + tol:
            if tried[k][0] > best[0]:
                best, x = tried[k], x + STEPS[k] * direction
            break
        step = STEPS[k] * direction
        best, x = tried[k], x + step
    phi, theta = from_partial(EDGE * np.tanh(x[:p])), -from_partial(EDGE * np.tanh(x[p:]))
    llf, sigma2, mean = best
    k = p + q + 1 + constant
    rows = ([("mean", mean)] if constant else []) + [(f"ar{i + 1}", v) for i, v in enumerate(phi)] + [(f"ma{i + 1}", v) for i, v in enumerate(theta)]
    rows += [("sigma2", sigma2), ("llf", llf), ("aic", 2 * k - 2 * llf), ("aicc", 2 * k - 2 * llf + 2 * k * (k + 1) / max(n - k - 1, 1)),
             ("bic", k * math.log(n) - 2 * llf), ("nobs", n)]
    return long_y.sparkSession.createDataFrame([(a, float(b)) for a, b in rows], "term string, coef double")

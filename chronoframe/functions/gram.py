"""Second-moment (Gram) matrices of lagged designs and the small solves on them.

Every linear model of the library (ADF, AR/VAR, Granger, walk-forward) is a
function of ``sum z z^T`` over the rows of a lagged design ``z``.  The sum is
one Spark aggregate (partial sums per task, merged after the shuffle), so the
raw rows never leave the executors; only a K x K matrix per series does."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

def unpack(g, k: int) -> np.ndarray:
    """Upper-triangle array -> full symmetric K x K matrix."""
    m = np.zeros((k, k))
    iu = np.triu_indices(k)
    m[iu] = np.asarray(g, dtype=float)
    return m + np.triu(m, 1).T


def ols_from_gram(G: np.ndarray, x_idx: Sequence[int], y_idx: Sequence[int], n: int):
    """OLS of columns ``y_idx`` on ``x_idx`` using only the Gram matrix.

    Returns (beta [kx, ky], ssr [ky], xtx_inv [kx, kx]).  Solved by least
    squares on the normal equations with a pseudo-inverse fallback."""
    x_idx, y_idx = list(x_idx), list(y_idx)
    xtx = G[np.ix_(x_idx, x_idx)]
    xty = G[np.ix_(x_idx, y_idx)]
    yty = G[np.ix_(y_idx, y_idx)]
    scale = np.sqrt(np.clip(np.diag(xtx), 1e-300, None))
    xs = xtx / np.outer(scale, scale)
    try:
        inv_s = np.linalg.inv(xs)
        if not np.all(np.isfinite(inv_s)) or np.linalg.cond(xs) > 1e14:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        inv_s = np.linalg.pinv(xs)
    inv = inv_s / np.outer(scale, scale)
    beta = inv @ xty
    ssr = np.diag(yty - xty.T @ beta - beta.T @ xty + beta.T @ xtx @ beta)
    # what is left of a perfect fit is rounding error, not zero
    return beta, np.maximum(ssr, np.finfo(float).eps * np.clip(np.diag(yty), 1e-300, None)), inv


def unpack_each(g: np.ndarray, k: int) -> np.ndarray:
    """:func:`unpack` of every row of ``g``."""
    m = np.zeros((len(g), k, k))
    i, j = np.triu_indices(k)
    m[:, i, j] = m[:, j, i] = g
    return m


def ols_each(G: np.ndarray, x_idx: Sequence[int], y_idx: Sequence[int]):
    """:func:`ols_from_gram` of every matrix of a stack."""
    x_idx, y_idx = list(x_idx), list(y_idx)
    xtx, xty, yty = (G[:, r][:, :, c] for r, c in ((x_idx, x_idx), (x_idx, y_idx), (y_idx, y_idx)))
    diag = np.einsum("nii->ni", xtx)
    scale = np.sqrt(np.clip(diag, 1e-300, None))
    scale = scale[:, :, None] * scale[:, None, :]
    xs = xtx / scale
    bad = ~np.isfinite(xs).all(axis=(1, 2))
    bad[~bad] = ~(np.linalg.cond(xs[~bad]) <= 1e14)
    inv = np.empty_like(xs)
    inv[~bad] = np.linalg.inv(xs[~bad])
    if bad.any():
        inv[bad] = np.linalg.pinv(xs[bad])
    inv = inv / scale
    beta = inv @ xty
    back = xty.transpose(0, 2, 1) @ beta
    ssr = np.einsum("nii->ni", yty - back - back.transpose(0, 2, 1) + beta.transpose(0, 2, 1) @ xtx @ beta)
    return beta, np.maximum(ssr, np.finfo(float).eps * np.clip(np.einsum("nii->ni", yty), 1e-300, None)), inv


def stacked_ols(grams: np.ndarray, kx: int) -> np.ndarray:
    """Coefficients [n, kx, ky] of a stack of Gram matrices whose first ``kx``
    columns are the regressors; ill-conditioned ones by pseudo-inverse."""
    xtx, xty = grams[:, :kx, :kx], grams[:, :kx, kx:]
    scale = np.sqrt(np.clip(np.einsum("nii->ni", xtx), 1e-300, None))
    xs = xtx / (scale[:, :, None] * scale[:, None, :])
    ys = xty / scale[:, :, None]
    try:
        inv = np.linalg.inv(xs)
        size = np.linalg.norm(inv, axis=(1, 2)) * np.linalg.norm(xs, axis=(1, 2))
        bad = ~np.isfinite(size) | (size > 1e14)
    except np.linalg.LinAlgError:
        inv, bad = np.zeros_like(xs), np.ones(len(xs), bool)
    if bad.any():
        inv[bad] = np.linalg.pinv(xs[bad])
    return (inv @ ys) / scale[:, :, None]


def ols_aic(ssr: float, n: int, k: int) -> float:
    """OLS information criterion with the Gaussian log-likelihood."""
    llf = -n / 2.0 * (np.log(2 * np.pi) + np.log(ssr / n) + 1.0)
    return -2.0 * llf + 2.0 * k

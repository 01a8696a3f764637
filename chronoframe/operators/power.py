"""Variance-stabilising power transforms (Box-Cox when the column is
positive, Yeo-Johnson otherwise) with the exponent chosen by maximum
likelihood.  One pass over the column evaluates the likelihood at a whole grid
of exponents; each further pass refines the grid around the best one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_WIDTH = 64.0                                # of the searched range of exponents


def _bc(x, lam: float):
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1.0) / lam


def _yj(x, lam: float):
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(-x + 1.0, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def _llf_exprs(col: str, lams, boxcox: bool):
    x = F.col(col)
    out = []
    for i, lam in enumerate(lams):
        y = _bc(x, lam) if boxcox else _yj(x, lam)
        out += [F.var_pop(y).alias(f"v{i}")]
    jac = F.log(x) if boxcox else F.signum(x) * F.log1p(F.abs(x))
    out.append(F.sum(jac).alias("j"))
    return out


def _llfs(df, col, lams, boxcox):
    r = df.agg(F.count(col).alias("n"), *_llf_exprs(col, lams, boxcox)).first()
    # var_pop centres as it goes: no difference of two large sums
    return [(lam - 1.0) * r["j"] - r["n"] / 2.0 * math.log(max(r[f"v{i}"], 1e-300)) for i, lam in enumerate(lams)]


def stabilize_variance(df: DataFrame, col: str, lo: float = -2.0, hi: float = 2.0, steps: int = 41,
                       tol: float = 1e-6) -> tuple[DataFrame, float]:
    """Returns (frame with ``col`` transformed, lambda)."""
    mn = df.agg(F.min(col)).first()[0]
    boxcox = mn is not None and mn > 0
    if mn is None:
        return df, 1.0                          # no values: the identity, but for a constant
    while True:
        grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
        vals = _llfs(df, col, grid, boxcox)
        k = max(range(steps), key=lambda i: vals[i])
        if 0 < k < steps - 1:
            break
        width = hi - lo
        if width > MAX_WIDTH or len(set(vals)) == 1:
            raise ValueError(f"the likelihood of {col} has no maximum between {lo} and {hi}")
        # the maximum is on the edge: a window twice as wide, that way
        lo, hi = (lo - width, hi) if k == 0 else (lo, hi + width)
    a, b = grid[k - 1], grid[k + 1]
    while b - a > tol:
        grid = [a + (b - a) * i / (steps - 1) for i in range(steps)]
        vals = _llfs(df, col, grid, boxcox)
        k = max(range(steps), key=lambda i: vals[i])
        a, b = grid[max(k - 1, 0)], grid[min(k + 1, steps - 1)]
    lam = (a + b) / 2
    y = _bc(F.col(col), lam) if boxcox else _yj(F.col(col), lam)
    return df.withColumn(col, y), lam

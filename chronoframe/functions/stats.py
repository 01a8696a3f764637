"""Distribution tails and test tables (scipy/statsmodels are not available).

All functions are scalar Python used on already aggregated, schema-sized
results (p-values of a handful of statistics per series)."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Inverse normal CDF: rational initial guess refined by Newton steps."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    # Initial value from the logistic-like approximation, then Newton on erfc.
    q = p - 0.5
    if abs(q) < 0.425:
        x = q * math.sqrt(2 * math.pi)
    else:
        r = p if q < 0 else 1 - p
        t = math.sqrt(-2.0 * math.log(r))
        x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3)
        x = -x if q < 0 else x
    for _ in range(60):
        err = norm_cdf(x) - p
        pdf = math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        if pdf == 0:
            break
        step = err / pdf
        x -= step
        if abs(step) < 1e-15 * max(1.0, abs(x)):
            break
    return x


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution for integer ``df``."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    if x <= 0:
        return 1.0
    df = int(df)
    h = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return min(1.0, math.exp(-h) * total)
    q = math.erfc(math.sqrt(h))
    term = math.sqrt(h) * math.exp(-h) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        q += term
        term *= h / (i + 1.5)
    return min(1.0, q)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by its power series
    x^a (1 - x)^b / (a B(a, b)) * sum_n prod_{j < n} (a + b + j) / (a + 1 + j) x^n
    on the side where the series converges fast: beyond the mean a / (a + b),
    or where few of its terms grow, that is the other one."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > a / (a + b) or (x > 0.9 and (1.0 - x) * (a + b) < 50):
        return 1.0 - betainc_series(b, a, 1.0 - x)
    return betainc_series(a, b, x)


def betainc_series(a: float, b: float, x: float) -> float:
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1.0) - math.lgamma(b))
    total = term = 1.0
    n = 0
    while term > 1e-17 * total and n < 1_000_000:
        term *= (a + b + n) / (a + 1.0 + n) * x
        total += term
        n += 1
    return min(1.0, front * total)


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x)
    return tail if t >= 0 else 1.0 - tail


# MacKinnon (1994) response-surface coefficients for the
# p-value of the Dickey-Fuller tau statistic, one series, constant term:
#   tau_min = -18.83, tau_max = 2.74, tau_star = -1.61
#   small p: 2.1659, 1.4412, 0.038269
#   large p: 1.7339, 0.93202, -0.12745, -0.010368
_TAU_MIN, _TAU_MAX, _TAU_STAR = -18.83, 2.74, -1.61
_SMALLP = (2.1659, 1.4412, 0.038269)
_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)

# MacKinnon (2010) critical values, constant term, one series:
#   1 %: -3.43035, -6.5393, -16.786, -79.433
#   5 %: -2.86154, -2.8903, -4.234, -40.04
#  10 %: -2.56677, -1.5384, -2.809
_CRIT = {"1%": (-3.43035, -6.5393, -16.786, -79.433),
         "5%": (-2.86154, -2.8903, -4.234, -40.04),
         "10%": (-2.56677, -1.5384, -2.809)}


def mackinnon_p(tau: float) -> float:
    if tau <= _TAU_MIN:
        return 0.0
    if tau >= _TAU_MAX:
        return 1.0
    coef = _SMALLP if tau <= _TAU_STAR else _LARGEP
    return norm_cdf(sum(c * tau ** i for i, c in enumerate(coef)))


def mackinnon_crit(nobs: int) -> dict:
    return {k: sum(c / nobs ** i for i, c in enumerate(v)) for k, v in _CRIT.items()}


def bh_adjust(p: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg adjusted p-values (reference implementation for tests)."""
    p = np.asarray(p, dtype=float)
    m = len(p)
    order = np.argsort(p)[::-1]
    ranks = np.arange(m, 0, -1)
    adj = np.minimum.accumulate(p[order] * m / ranks)
    out = np.empty(m)
    out[order] = np.minimum(adj, 1.0)
    return out

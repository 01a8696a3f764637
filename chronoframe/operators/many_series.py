"""ARIMA models and forecasts for any number of series at once.

The two regressions of Hannan and Rissanen run for all series in the same jobs:
per series one Gram aggregate and one small solve on an executor, many at a time.  The long
autoregression's coefficients are a table that is joined back to the rows, where
the innovations are a JVM expression; the second regression's coefficients, the
last observations and the last innovations are tables too, and a forecast is a
recursion over one joined row.  The driver gets one number: the longest lag.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gram import ols_each, unpack_each
from ..functions.stats import norm_ppf
from ..session import cut_lineage
from .groups import arrays, map_rows, matrix
from .linear import SERIES, STACK, _diff_poly, _key_schema, _poly_mul, _with_constant, _with_series, gram, sarima_lags
from .ordering import halo_window, lagged
from .validate import require


def _differenced(y: DataFrame, poly: np.ndarray, keys, idx: str, value: str, size) -> DataFrame:
    """``poly``(L) y per series; the index begins at 0 again."""
    k0 = len(poly) - 1
    if not k0:
        return y

    def ex(w):
        e = F.col(value)
        for k in range(1, k0 + 1):
            if poly[k]:
                e = e + F.lit(float(poly[k])) * F.lag(value, k).over(w)
        return {value: e}
    return halo_window(y, ex, idx, keys, before=k0, size=size).where(F.col(idx) >= k0).withColumn(idx, F.col(idx) - k0)


def _dot(coefs: str, columns: list):
    """Constant and sum of coefficient times column; a missing lag counts as 0."""
    out = F.col(coefs)[0]
    for i, c in enumerate(columns):
        out = out + F.col(coefs)[i + 1] * F.coalesce(c, F.lit(0.0))
    return out


def _innovations(w: DataFrame, keys: list[str], ar: list[int], ma: list[int], idx: str, value: str, size) -> DataFrame:
    """Rows of ``w`` with ``_m`` (rows that the long autoregression needs) and,
    from row ``_m`` on, its residual ``_e``.  Without MA lags ``_m`` is 0."""
    if not ma:
        return w.withColumn("_m", F.lit(0)).withColumn("_e", F.lit(0.0))
    n = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = 2 * max(max(ar, default=0), max(ma), 1)
    m = F.greatest(F.lit(least), F.least(F.rint(F.log("_n") ** 2), F.floor(F.col("_n") / 4))).cast("int")
    lengths = cut_lineage(n.withColumn("_m", m).where(F.col("_n") > 2 * F.col("_m") + 2).drop("_n"))
    most = lengths.agg(F.max("_m")).first()[0] or least         # one number
    lg = lagged(w, [value], lags=range(1, most + 1), idx=idx, keys=keys, size=size).join(lengths, keys)
    lags = [F.col(f"{value}_lag{k}") for k in range(1, most + 1)]
    # lags beyond a series' own number count as 0 and are left out of its solve
    z = [F.lit(1.0)] + [F.coalesce(c, F.lit(0.0)) for c in lags] + [F.col(value)]
    rows = lg.where(F.col(idx) >= F.col("_m"))
    g = gram(rows, z, [*keys, "_m"])

    def solve(table):
        G, own = unpack_each(matrix(table.column("g")), most + 2), table.column("_m").to_numpy()
        phi = np.zeros((len(G), most + 1))
        for m in np.unique(own):
            phi[own == m, :m + 1] = ols_each(G[own == m], range(m + 1), [most + 1])[0][:, :, 0]
        return {k: table.column(k) for k in keys} | {"_phi": arrays(phi)}

    phi = map_rows(g, solve, f"{_key_schema(g, keys)}, _phi array<double>", STACK)
    return rows.join(phi, keys).select(*keys, idx, value, "_m", (F.col(value) - _dot("_phi", lags)).alias("_e"))


def _second_stage(w: DataFrame, keys: list[str], ar: list[int], ma: list[int], idx: str, value: str, size):
    """(rows with their lags, regressors, Gram table) of the regression on value
    and innovation lags, each series from its first complete row on."""
    rows = _innovations(w, keys, ar, ma, idx, value, size)
    longest = max([*ar, *ma], default=0)
    names = [(value, k) for k in ar] + [("_e", k) for k in ma]

    def ex(win):
        return {f"{c}_lag{k}": F.lag(c, k).over(win) for c, k in names}
    lg = halo_window(rows, ex, idx, keys, before=longest, size=size) if names else rows
    lg = cut_lineage(lg.where(F.col(idx) >= F.col("_m") + longest))
    x = [F.col(f"{c}_lag{k}") for c, k in names]
    return lg, x, gram(lg, [F.lit(1.0), *x, F.col(value)], keys)


def arima_many(df: DataFrame, order: tuple = (1, 0, 0), seasonal: tuple | None = None, steps: int = 0, alpha: float = 0.05,
               keys: Sequence[str] = (), idx: str = "idx", value: str = "value", trend: str | None = None,
               size: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """F1/F4/F6 for every series of ``keys``: (coefficients, forecasts).

    The model is that of :func:`linear.sarima` (the same two regressions, lag
    sets, default constant and intervals).  Coefficients: keys, term, coef,
    std_err; forecasts of ``steps`` steps: keys, idx, mean, lower, upper.
    ``idx`` is 0, 1, ... within a series and values are not missing.  A series
    too short for the regressions (no more rows than regressors and one) has no
    rows in either table."""
    constant = _with_constant(trend, False)
    if seasonal and seasonal[3] and tuple(order) == (0, 0, 0):
        order = (1, 0, 0)
    ar, ma, d, D, s = sarima_lags(tuple(order), tuple(seasonal) if seasonal else None)
    d0, keys = _with_series(df, keys)
    y = d0.select(*keys, idx, F.col(value).cast("double").alias(value))
    poly = _diff_poly(d, D, s)
    w = _differenced(y, poly, keys, idx, value, size)
    rows, x, g = _second_stage(w, keys, ar, ma, idx, value, size)
    mm = len(x) + 2
    kinds = _key_schema(g, keys)
    names = ["const"] + [f"ar_L{k}" for k in ar] + [f"ma_L{k}" for k in ma]

    xs = list(range(0 if constant else 1, mm - 1))

    def solve(table):
        G = unpack_each(matrix(table.column("g")), mm)
        b, var, ssr = np.zeros((len(G), mm - 1)), np.zeros((len(G), mm - 1)), G[:, -1, -1]
        if xs:
            beta, left, inv = ols_each(G, xs, [mm - 1])
            b[:, xs], var[:, xs], ssr = beta[:, :, 0], np.einsum("nii->ni", inv), left[:, 0]
        return {k: table.column(k) for k in keys} | {"b": arrays(b), "var": arrays(var), "ssr": ssr, "n": table.column("n"),
                                                     "kx": np.full(len(G), len(xs))}

    fit = cut_lineage(map_rows(g.where(F.col("n") > mm), solve, f"{kinds}, b array<double>, var array<double>, ssr double, n long, kx long", STACK))

    s2, n, k = F.col("ssr") / F.greatest(F.col("n") - F.col("kx"), F.lit(1)), F.col("n"), F.col("kx") + 1
    llf = -n / 2.0 * (F.lit(math.log(2 * math.pi)) + F.log(F.col("ssr") / n) + 1.0)

    def term(name, coef, err=None):
        return F.struct(F.lit(name).alias("term"), coef.cast("double").alias("coef"), (F.lit(None) if err is None else err).cast("double").alias("std_err"))
    terms = [term(nm, F.col("b")[i], F.sqrt(F.greatest(s2 * F.col("var")[i], F.lit(0.0)))) for i, nm in enumerate(names) if i or constant]
    terms += [term("sigma2", F.col("ssr") / n), term("aic", -2 * llf + 2 * k), term("bic", -2 * llf + k * F.log(n)), term("nobs", n)]
    coefs = fit.select(*keys, F.explode(F.array(*terms)).alias("_t")).select(*keys, "_t.*")
    drop = SERIES if SERIES in keys else None
    if not steps:
        return (coefs.drop(drop) if drop else coefs), None

    longest_ar = (max(ar, default=0) + len(poly) - 1)
    qm = max(ma, default=0)
    # the last rows of every series: at most as many as the polynomial is long
    ends = y.groupBy(*keys).agg(F.max(idx).alias("_last"))
    tail = y.join(ends, keys).where(F.col(idx) > F.col("_last") - max(longest_ar, 1)).groupBy(*keys, "_last").agg(
        F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))).alias("_ys"))
    joined = fit.join(tail, keys)
    if qm:
        final = rows.join(fit.select(*keys, "b"), keys).select(*keys, idx, (F.col(value) - _dot("b", x)).alias("_r"))
        stop = rows.groupBy(*keys).agg(F.max(idx).alias("_stop"))
        es = final.join(stop, keys).where(F.col(idx) > F.col("_stop") - qm).groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("_r").alias("v")))).alias("_es"))
        joined = joined.join(es, keys)
    zq = norm_ppf(1 - alpha / 2)

    def forecast(batches):
        for pdf in batches:
            parts = []
            for row in pdf.to_dict("records"):
                b = np.asarray(row["b"], float)
                aw, th = np.zeros(max(ar, default=0) + 1), np.zeros(qm + 1)
                aw[0] = th[0] = 1.0
                for i, lag in enumerate(ar):
                    aw[lag] -= b[1 + i]
                for i, lag in enumerate(ma):
                    th[lag] += b[1 + len(ar) + i]
                ay = _poly_mul(aw, poly)
                ys = [e["v"] for e in row["_ys"]]
                es = [e["v"] for e in row["_es"]] if qm else []
                psi, sd2 = [1.0], 0.0
                for h in range(steps):
                    if h:
                        psi.append((th[h] if h <= qm else 0.0) - sum(ay[k] * psi[h - k] for k in range(1, min(h, len(ay) - 1) + 1)))
                    mean = b[0] - sum(ay[k] * ys[-k] for k in range(1, len(ay)))
                    mean += sum(th[k] * es[-k] for k in range(1, qm + 1) if k <= len(es))
                    ys.append(mean)
                    es.append(0.0)
                    sd2 += psi[h] ** 2
                    half = zq * math.sqrt(row["ssr"] / row["n"] * sd2)
                    parts.append([row[k] for k in keys] + [int(row["_last"]) + 1 + h, float(mean), float(mean - half), float(mean + half)])
            yield pd.DataFrame(parts, columns=[*keys, idx, "mean", "lower", "upper"], dtype=None if parts else object)

    fc = joined.mapInPandas(forecast, f"{kinds}, `{idx}` long, mean double, lower double, upper double")
    return (coefs.drop(drop), fc.drop(drop)) if drop else (coefs, fc)


def arima_grid(df: DataFrame, limit_p: int, limit_q: int, d: int = 0, s: int = 0, keys: Sequence[str] = (), idx: str = "idx",
               value: str = "value", size: int | None = None) -> DataFrame:
    """F7 for every series of ``keys``: AIC, AICc and BIC of order (p, d, q) for
    p < ``limit_p`` and q < ``limit_q`` or, with a period ``s``, of seasonal
    order (p, d, q, s) beside an AR(1).  One Gram per series over all lags of the
    grid; every cell is a sub-block solve on the common sample.  Output: keys, p,
    q, nobs, aic, aicc, bic; a series too short for the largest cell has no rows."""
    require(limit_p >= 1 and limit_q >= 1, "max p and max q must be >= 1")
    P, Q = limit_p - 1, limit_q - 1
    d0, keys = _with_series(df, keys)
    y = d0.select(*keys, idx, F.col(value).cast("double").alias(value))

    def lags(p, q):
        return sarima_lags((1, 0, 0), (p, 0, q, s))[:2] if s else sarima_lags((p, 0, q), None)[:2]
    ar, ma = lags(P, Q)
    w = _differenced(y, _diff_poly(0 if s else d, d if s else 0, s), keys, idx, value, size)
    _, x, g = _second_stage(w, keys, ar, ma, idx, value, size)
    mm = len(x) + 2

    def cells(table):
        G, n = unpack_each(matrix(table.column("g")), mm), table.column("n").to_numpy()
        parts = []
        for p in range(limit_p):
            for q in range(limit_q):
                a, m = lags(p, q)
                xs = [0, *(1 + ar.index(k) for k in a), *(1 + len(ar) + ma.index(k) for k in m)]
                ssr = ols_each(G, xs, [mm - 1])[1][:, 0]
                k = len(xs) + 1                 # + innovation variance
                dev = n * (math.log(2 * math.pi) + np.log(ssr / n) + 1.0)
                parts.append(pa.table({c: table.column(c) for c in keys} | {
                    "p": np.full(len(n), p, np.int32), "q": np.full(len(n), q, np.int32), "nobs": n, "aic": dev + 2 * k,
                    "aicc": dev + 2 * k + 2.0 * k * (k + 1) / np.maximum(n - k - 1, 1), "bic": dev + k * np.log(n)}))
        whole = pa.concat_tables(parts)
        return {c: whole.column(c) for c in whole.column_names}

    out = map_rows(g.where(F.col("n") > mm), cells, f"{_key_schema(g, keys)}, p int, q int, nobs long, aic double, aicc double, bic double", STACK)
    return out.drop(SERIES) if SERIES in keys else out

"""Linear time-series models from lagged Gram matrices.

Plan shared by every model here:

1. lagged design columns by one halo pass (``ordering.lagged``);
2. ``Z^T Z`` of the design in one Spark aggregate per series (partial sums
   per task, merged after the shuffle) -- for models that need a different
   sample per lag order, the few boundary rows ``idx < max_lag`` (at most
   ``max_lag`` rows per series) are shipped alongside the Gram;
3. the K x K solves run in ``applyInPandas`` grouped by series, so many
   series are solved in parallel and the raw rows never leave the executors.

Walk-forward evaluation uses *prefix* Gram matrices: per block of rows a
partial Gram, a carry (sum over earlier blocks) from the tiny block table, and
one small solve per test row inside the block task -- no refit job per step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gram import ols_aic, ols_from_gram, stacked_ols, unpack
from ..functions.stats import chi2_sf, mackinnon_crit, mackinnon_p, norm_ppf
from ..session import block_size
from .ordering import BLK, _cols, add_blocks, halo_window, lagged
from .validate import complete, maybe_broadcast, require

V = "variable"
STACK = 1024                                    # fits solved at a time
SERIES = "_series"


def _with_series(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    keys = _cols(keys)
    if keys:
        return df, keys
    return df.withColumn(SERIES, F.lit(0)), [SERIES]


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)


def _triu_products(cols: list) -> list:
    k = len(cols)
    return [cols[i] * cols[j] for i in range(k) for j in range(i, k)]


# Above this many Gram entries the aggregate is computed per partition with
# numpy instead of one generated SQL sum per entry (codegen method size).
SQL_GRAM_LIMIT = 400


def _gram_numpy(design: DataFrame, z: list, keys: list[str]) -> DataFrame:
    """Per partition and series ``Z^T Z`` with numpy, emitted as (keys, k, v)
    triangle entries and merged by a distributed ``groupBy(keys, k).sum``."""
    d = len(z)
    tri = np.triu_indices(d)
    src = design.select(*keys, *[e.alias(f"_z{i}") for i, e in enumerate(z)])
    kschema = _key_schema(design, keys)

    def part(it):
        for pdf in it:
            if pdf.empty:
                continue
            for kv, g in pdf.groupby(keys, sort=False):
                Z = g[[f"_z{i}" for i in range(d)]].to_numpy(dtype=float)
                vals = (Z.T @ Z)[tri]
                out = pd.DataFrame({"_k": np.arange(len(vals), dtype=np.int64), "_v": vals, "_c": len(Z)})
                kv = kv if isinstance(kv, tuple) else (kv,)
                for k, v in zip(keys, kv):
                    out[k] = v
                yield out[[*keys, "_k", "_v", "_c"]]

    ent = src.mapInPandas(part, f"{kschema}, _k long, _v double, _c long")
    merged = ent.groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"), F.sum("_c").alias("_c"))
    return merged.groupBy(*keys).agg(
        F.max(F.when(F.col("_k") == 0, F.col("_c"))).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("g"))


def gram(design: DataFrame, z: list, keys: list[str]) -> DataFrame:
    """keys, n, g (upper triangle of Z^T Z) over the rows without a missing
    value, with the cheaper of the two plans."""
    d = len(z)
    whole = z[0].isNotNull()
    for e in z[1:]:
        whole = whole & e.isNotNull()
    design = design.where(whole)
    if d * (d + 1) // 2 > SQL_GRAM_LIMIT:
        return _gram_numpy(design, z, keys)
    return design.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     F.array(*[F.sum(e) for e in _triu_products(z)]).alias("g"))


def gram_with_boundary(design: DataFrame, zcols: Sequence[str], keys: list[str], idx: str, start,
                       boundary_from: int) -> DataFrame:
    """Per series: Gram of ``[1, zcols]`` over rows ``idx >= start`` plus the
    rows ``boundary_from <= idx < start`` as arrays (NULL lags as NaN).
    ``start`` is a number, or a column with each series' own start.
    Output: keys, n, g (upper triangle), bidx (array), bz (array of arrays)."""
    z = [F.lit(1.0)] + [F.col(c).cast("double") for c in zcols]
    main = gram(design.where(F.col(idx) >= start), z, keys)
    if not isinstance(start, Column) and start <= boundary_from:
        return main.withColumn("bidx", F.array().cast("array<long>")).withColumn(
            "bz", F.array().cast("array<array<double>>"))
    nan = F.lit(float("nan"))
    bnd = design.where((F.col(idx) >= boundary_from) & (F.col(idx) < start)).select(
        *keys, F.col(idx).cast("long").alias("_i"), F.array(*[F.coalesce(e, nan) for e in z]).alias("_z"))
    bnd = bnd.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_z")).alias("_b"))   # < start rows per series
    out = main.join(bnd, keys, "left")
    return out.select(*keys, "n", "g", F.col("_b._i").alias("bidx"), F.col("_b._z").alias("bz"))


def _gram_at(row, m: int, start: int, from_idx: int) -> tuple[np.ndarray, int]:
    """Gram over rows idx >= from_idx given the Gram over idx >= start and the boundary rows."""
    G = unpack(row["g"], m)
    n = int(row["n"])
    bidx = row["bidx"] if row["bidx"] is not None else []
    bz = row["bz"] if row["bz"] is not None else []
    for i, z in zip(bidx, bz):
        if from_idx <= i < start:
            zz = np.asarray(z, dtype=float)
            G = G + np.outer(zz, zz)
            n += 1
    return G, n


# ----------------------------------------------------------------------- ADF

def adf(long: DataFrame, idx: str = "idx", keys=(V,), value: str = "value", maxlag: int | None = None,
        size: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with constant, lag order by AIC on
    the common sample, final fit on the full usable sample, MacKinnon p-value
    and critical values.  The largest lag follows each series' own length; a
    series of fewer than 6 rows gets NULLs; a missing value fails the query.  Output per series: adf_stat, p_value, used_lag,
    nobs, crit_1, crit_5, crit_10, stationary (p <= 0.05)."""
    keys = _cols(keys)
    what = "the stationarity test"
    x0 = complete(F.col(value), what)
    # every series has its own lag bound; subtracting its mean keeps the Gram well conditioned
    stats = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"))
    bound = F.lit(maxlag) if maxlag is not None else F.least(
        F.ceil(F.lit(12.0) * F.pow(F.col("_n") / 100.0, F.lit(0.25))), F.floor(F.col("_n") / 2) - 2)
    stats = stats.select(*keys, "_n", "_mean", F.greatest(bound, F.lit(0)).cast("int").alias("_L"))
    L = stats.where("_n >= 6").agg(F.max("_L")).first()[0]
    L = 0 if L is None else int(L)
    cur = long.select(*keys, idx, x0.alias(value)).join(maybe_broadcast(stats.where("_n >= 6")), keys)
    cur = cur.select(*keys, idx, "_L", (F.col(value) - F.col("_mean")).alias(value))
    lg = halo_window(cur, lambda w: {f"{value}_lag{k}": F.lag(value, k).over(w) for k in range(1, L + 2)},
                     idx, keys, before=L + 1, size=size)
    x = [F.col(value)] + [F.col(f"{value}_lag{k}") for k in range(1, L + 2)]
    # lags beyond a series' own bound are not used: 0
    design = lg.select(*keys, idx, "_L", (x[0] - x[1]).alias("_dy"), x[1].alias("_y1"),
                       *[F.when(F.lit(k) <= F.col("_L"), x[k] - x[k + 1]).otherwise(0.0).alias(f"_dl{k}")
                         for k in range(1, L + 1)])
    zcols = ["_y1"] + [f"_dl{k}" for k in range(1, L + 1)] + ["_dy"]
    gb = gram_with_boundary(design, zcols, keys, idx, F.col("_L") + 1, 1)
    gb = stats.join(gb, keys, "left")           # a series that is too short keeps its row
    m = len(zcols) + 1
    schema = _key_schema(gb, keys) + (", adf_stat double, p_value double, used_lag int, nobs long, "
                                      "crit_1 double, crit_5 double, crit_10 double, stationary boolean")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        out = {k: [row[k]] for k in keys}
        own, y = int(row["_L"]), m - 1
        best = None
        if row["g"] is not None:
            G = unpack(row["g"], m)
            nn = int(row["n"])
            for lag in range(0, own + 1):
                xs = list(range(0, 2 + lag))           # const, y_{t-1}, dy lags
                if nn <= len(xs):
                    break
                _, ssr, _ = ols_from_gram(G, xs, [y], nn)
                aic = ols_aic(float(ssr[0]), nn, len(xs))
                if best is None or aic < best[0]:
                    best = (aic, lag)
        if best is None:
            out.update(adf_stat=[None], p_value=[None], used_lag=[None], nobs=[None], crit_1=[None], crit_5=[None],
                       crit_10=[None], stationary=[None])
            return pd.DataFrame(out).astype({"used_lag": "Int32", "nobs": "Int64", "stationary": "boolean"})
        lag = best[1]
        Gf, nf = _gram_at(row, m, own + 1, lag + 1)
        xs = list(range(0, 2 + lag))
        beta, ssr, inv = ols_from_gram(Gf, xs, [y], nf)
        sigma2 = float(ssr[0]) / (nf - len(xs))
        tstat = float(beta[1, 0] / math.sqrt(sigma2 * inv[1, 1]))
        crit = mackinnon_crit(nf)
        p = mackinnon_p(tstat)
        out.update(adf_stat=[tstat], p_value=[p], used_lag=[lag], nobs=[nf], crit_1=[crit["1%"]],
                   crit_5=[crit["5%"]], crit_10=[crit["10%"]], stationary=[p <= 0.05])
        return pd.DataFrame(out)

    return gb.groupBy(*keys).applyInPandas(solve, schema)


def stationarity(adf_df: DataFrame, missing: bool = False, keys=()) -> DataFrame:
    """Dataset-level verdict: 'stationary' when every variable has
    p <= 0.05, 'not stationary' otherwise, 'unknown' with missing values."""
    k = _cols(keys)
    verdict = F.when(F.lit(missing), "unknown").when(F.bool_and(F.col("p_value") <= 0.05), "stationary").otherwise(
        "not stationary")
    return adf_df.groupBy(*k).agg(verdict.alias("verdict"), F.max("p_value").alias("max_p_value"))


# ------------------------------------------------------------------- Granger

def _wide_lag_design(df: DataFrame, cols: list[str], L: int, idx: str, keys: list[str], size):
    whole = df.select(*keys, idx, *[complete(F.col(c), "a model of lagged values").alias(c) for c in cols])
    lg = lagged(whole, cols, lags=range(1, L + 1), idx=idx, keys=keys, size=size)
    zcols = list(cols) + [f"{c}_lag{k}" for k in range(1, L + 1) for c in cols]
    return lg, zcols


def granger(df: DataFrame, cols: Sequence[str], maxlag: int = 10, idx: str = "idx", keys=(),
            pairs: Sequence[tuple[str, str]] | None = None, size: int | None = None,
            fanout: bool | None = None) -> DataFrame:
    """Granger causality (ssr chi-square test) of ``source -> target``
    for every ordered pair and lag 1..maxlag.  One joint Gram over all
    variables and lags (rows idx >= maxlag) plus the boundary rows serves all
    K^2 x maxlag regressions; the lag-l tests use rows idx >= l as in the
    pairwise test.  The diagonal (a variable with itself) is NULL.
    Output: keys, target, source, lag, chi2, p_value."""
    cols = list(cols)
    d0, keys = _with_series(df, keys)
    K, L = len(cols), maxlag
    lg, zcols = _wide_lag_design(d0, cols, L, idx, keys, size)
    gb = gram_with_boundary(lg, zcols, keys, idx, L, 1)
    m = len(zcols) + 1
    pos = {c: i + 1 for i, c in enumerate(cols)}
    lagpos = {(c, k): 1 + K + (k - 1) * K + i for k in range(1, L + 1) for i, c in enumerate(cols)}
    todo = list(pairs) if pairs is not None else [(t, s) for t in cols for s in cols]
    schema = _key_schema(gb, keys) + ", target string, source string, lag int, chi2 double, p_value double"
    if fanout is None:
        fanout = len(todo) * L > 2000
    if fanout:
        res = _granger_fanout(gb, keys, todo, pos, lagpos, m, L, schema)
        return res.drop(SERIES) if SERIES in keys else res

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        recs = []
        grams = {l: _gram_at(row, m, L, l) for l in range(1, L + 1)}
        for tgt, src in todo:
            for l in range(1, L + 1):
                if tgt == src:
                    recs.append((tgt, src, l, None, None))
                    continue
                G, n = grams[l]
                own = [0] + [lagpos[(tgt, k)] for k in range(1, l + 1)]
                joint = own + [lagpos[(src, k)] for k in range(1, l + 1)]
                _, ssr_r, _ = ols_from_gram(G, own, [pos[tgt]], n)
                _, ssr_u, _ = ols_from_gram(G, joint, [pos[tgt]], n)
                stat = n * (float(ssr_r[0]) - float(ssr_u[0])) / float(ssr_u[0]) if ssr_u[0] > 0 else float("nan")
                recs.append((tgt, src, l, stat, chi2_sf(stat, l)))
        out = pd.DataFrame(recs, columns=["target", "source", "lag", "chi2", "p_value"])
        for k in reversed(keys):
            out.insert(0, k, row[k])
        return out

    res = gb.groupBy(*keys).applyInPandas(solve, schema)
    return res.drop(SERIES) if SERIES in keys else res


def _granger_fanout(gb, keys, todo, pos, lagpos, m, L, schema):
    """Pairs spread over tasks: one pandas stage per series cuts, for every
    ordered pair, the (2L+2)-sized sub-Gram [1, target, target lags, source
    lags] and the matching boundary columns out of the joint Gram; a second
    stage grouped by (series, target, source) runs the L lag tests of one pair."""
    kschema = _key_schema(gb, keys)
    tri = np.triu_indices(2 * L + 2)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        G = unpack(row["g"], m)
        bidx = list(row["bidx"]) if row["bidx"] is not None else []
        bz = [np.asarray(z, dtype=float) for z in (row["bz"] if row["bz"] is not None else [])]
        recs = []
        for tgt, src in todo:
            cols_ = [0, pos[tgt]] + [lagpos[(tgt, k)] for k in range(1, L + 1)] + \
                [lagpos[(src, k)] for k in range(1, L + 1)]
            sub = G[np.ix_(cols_, cols_)][tri].tolist() if tgt != src else []
            recs.append((tgt, src, sub, int(row["n"]), bidx, [z[cols_].tolist() for z in bz] if tgt != src else []))
        out = pd.DataFrame(recs, columns=["target", "source", "g", "n", "bidx", "bz"])
        for k in reversed(keys):
            out.insert(0, k, row[k])
        return out

    cut_schema = kschema + (", target string, source string, g array<double>, n long, bidx array<long>, "
                            "bz array<array<double>>")
    per_pair = gb.groupBy(*keys).applyInPandas(cut, cut_schema)
    d = 2 * L + 2

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        tgt, src = row["target"], row["source"]
        recs = []
        for lag in range(1, L + 1):
            if tgt == src:
                recs.append((tgt, src, lag, None, None))
                continue
            G, n = _gram_at(row, d, L, lag)
            own = [0] + list(range(2, 2 + lag))
            joint = own + list(range(2 + L, 2 + L + lag))
            _, ssr_r, _ = ols_from_gram(G, own, [1], n)
            _, ssr_u, _ = ols_from_gram(G, joint, [1], n)
            stat = n * (float(ssr_r[0]) - float(ssr_u[0])) / float(ssr_u[0]) if ssr_u[0] > 0 else float("nan")
            recs.append((tgt, src, lag, stat, chi2_sf(stat, lag)))
        out = pd.DataFrame(recs, columns=["target", "source", "lag", "chi2", "p_value"])
        for k in reversed(keys):
            out.insert(0, k, row[k])
        return out

    return per_pair.groupBy(*keys, "target", "source").applyInPandas(solve, schema)


def granger_matrix(tests: DataFrame, keys=()) -> DataFrame:
    """The smallest p-value over lags for each (target, source)."""
    k = _cols(keys)
    return tests.groupBy(*k, "target", "source").agg(
        F.min("p_value").alias("p_value"), F.min_by("lag", "p_value").alias("best_lag"))


def filter_causality(mat: DataFrame, alpha: float = 0.05) -> DataFrame:
    """1 when p < alpha (an edge source -> target), else 0."""
    return mat.withColumn("edge", F.when(F.col("p_value") < alpha, 1).otherwise(0))


def granger_by_variable(tests: DataFrame, target: str, maxval: float = 0.05) -> DataFrame:
    """Sources that Granger-cause ``target`` with p < maxval, ascending."""
    require(maxval <= 0.05, "maxval above 0.05")
    m = granger_matrix(tests.where(F.col("target") == target))
    return m.where(F.col("p_value") < maxval).orderBy("p_value")


def causality_edges(mat: DataFrame, weight: str = "edge") -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a causality matrix (source -> target)."""
    nodes = mat.select(F.col("target").alias("node")).union(mat.select(F.col("source").alias("node"))).distinct()
    edges = mat.where((F.col(weight) == 1) & (F.col("source") != F.col("target"))).select("source", "target")
    return nodes, edges


def bh_correct(pvals: DataFrame, p: str = "p_value", keys=(), out: str = "q_value",
               size: int | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each family (``keys``):
    q_(i) = min_{j >= i} p_(j) m / j, capped at 1.  Ranks come from
    ``dense_index`` and the running minimum from the largest rank down is a
    blocked suffix-minimum, so a large family is never sorted in one task."""
    from .ordering import blocked_suffix_min, dense_index
    k = _cols(keys)
    tie = "_bh_row"
    src = pvals.where(F.col(p).isNotNull()).withColumn(tie, F.monotonically_increasing_id())
    ranked = dense_index(src, [p, tie], keys=k, idx="_rank")
    m = ranked.groupBy(*k).agg(F.count(F.lit(1)).alias("_m"))
    ranked = ranked.join(m, k) if k else ranked.withColumn("_m", F.lit(m.first()["_m"]))
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_rank") + 1))
    res = blocked_suffix_min(raw, "_raw", "_rank", k, size, out="_q")
    return res.withColumn(out, F.least(F.lit(1.0), F.col("_q"))).drop("_rank", "_m", "_raw", "_q", tie)


# ----------------------------------------------------------------------- VAR

def _var_criteria(sigma_mle: np.ndarray, T: int, K: int, p: int) -> dict:
    sign, ld = np.linalg.slogdet(sigma_mle)
    free = p * K * K + K
    dfm = K * p + 1
    return {"aic": ld + 2.0 * free / T, "bic": ld + math.log(T) * free / T,
            "hqic": ld + 2.0 * math.log(math.log(T)) * free / T,
            "fpe": ((T + dfm) / (T - dfm)) ** K * math.exp(ld)}


def var_fit(df: DataFrame, cols: Sequence[str], p: int, idx: str = "idx", keys=(),
            size: int | None = None, exog: Sequence[str] = ()) -> DataFrame:
    """F10 (F16 with ``exog``): VAR(p) with constant -- and contemporaneous
    exogenous regressors -- by least squares (one Gram, one solve for all
    equations).  Output: keys, equation, regressor, coef, std_err, plus one
    row per equation with regressor '_sigma_<var>' holding the residual
    covariance (denominator T - Kp - 1)."""
    cols = list(cols)
    exog = list(exog)
    d0, keys = _with_series(df, keys)
    K = len(cols)
    lg, zcols = _wide_lag_design(d0.select(*keys, idx, *cols, *exog), cols, p, idx, keys, size) \
        if not exog else _exog_design(d0, cols, exog, p, idx, keys, size)
    gb = gram_with_boundary(lg, zcols, keys, idx, p, p)
    m = len(zcols) + 1
    names = ["const"] + [f"{c}_lag{k}" for k in range(1, p + 1) for c in cols] + list(exog)
    schema = _key_schema(gb, keys) + ", equation string, regressor string, coef double, std_err double"

    def solve(pdf):
        row = pdf.iloc[0]
        G, n = unpack(row["g"], m), int(row["n"])
        xs = [0] + list(range(1 + K, m))
        ys = list(range(1, 1 + K))
        beta, _, inv = ols_from_gram(G, xs, ys, n)
        Gyy = G[np.ix_(ys, ys)]
        Gxy = G[np.ix_(xs, ys)]
        Gxx = G[np.ix_(xs, xs)]
        S = Gyy - Gxy.T @ beta - beta.T @ Gxy + beta.T @ Gxx @ beta
        sigma = S / (n - K * p - 1)
        recs = []
        for e, c in enumerate(cols):
            for r, nm in enumerate(names):
                recs.append((c, nm, float(beta[r, e]), float(math.sqrt(max(sigma[e, e] * inv[r, r], 0.0)))))
            for e2, c2 in enumerate(cols):
                recs.append((c, f"_sigma_{c2}", float(sigma[e, e2]), None))
        out = pd.DataFrame(recs, columns=["equation", "regressor", "coef", "std_err"])
        for k in reversed(keys):
            out.insert(0, k, row[k])
        return out

    res = gb.groupBy(*keys).applyInPandas(solve, schema)
    return res.drop(SERIES) if SERIES in keys else res


def _exog_design(df, cols, exog, p, idx, keys, size):
    lg = lagged(df.select(*keys, idx, *cols, *exog), cols, lags=range(1, p + 1), idx=idx, keys=keys, size=size)
    zcols = list(cols) + [f"{c}_lag{k}" for k in range(1, p + 1) for c in cols] + list(exog)
    return lg, zcols


def var_select_order(df: DataFrame, cols: Sequence[str], maxlags: int = 12, idx: str = "idx", keys=(),
                     size: int | None = None) -> DataFrame:
    """AIC, BIC, FPE, HQIC for p = 0..maxlags, all on the common sample
    idx >= maxlags (sub-blocks of one Gram)."""
    return _var_search(df, cols, maxlags, idx, keys, size, common=True)


def var_param_search(df: DataFrame, cols: Sequence[str], limit_p: int, idx: str = "idx", keys=(),
                     size: int | None = None) -> DataFrame:
    """AIC and BIC for p = 0..limit_p inclusive, each p on its own sample idx >= p."""
    require(limit_p >= 2, "max p must be >= 2")
    require(len(list(cols)) >= 2, "VAR search needs two or more variables")
    return _var_search(df, cols, limit_p, idx, keys, size, common=False)


def _var_search(df, cols, P, idx, keys, size, common):
    cols = list(cols)
    d0, keys = _with_series(df, keys)
    K = len(cols)
    lg, zcols = _wide_lag_design(d0, cols, P, idx, keys, size)
    gb = gram_with_boundary(lg, zcols, keys, idx, P, 0 if common else 0)
    m = len(zcols) + 1
    schema = _key_schema(gb, keys) + ", p int, nobs long, aic double, bic double, fpe double, hqic double"

    def solve(pdf):
        row = pdf.iloc[0]
        recs = []
        for p in range(0, P + 1):
            G, n = (unpack(row["g"], m), int(row["n"])) if common else _gram_at(row, m, P, p)
            xs = [0] + list(range(1 + K, 1 + K + K * p))
            ys = list(range(1, 1 + K))
            beta, _, _ = ols_from_gram(G, xs, ys, n)
            Gyy, Gxy, Gxx = G[np.ix_(ys, ys)], G[np.ix_(xs, ys)], G[np.ix_(xs, xs)]
            S = (Gyy - Gxy.T @ beta - beta.T @ Gxy + beta.T @ Gxx @ beta) / n
            c = _var_criteria(S, n, K, p)
            recs.append((p, n, c["aic"], c["bic"], c["fpe"], c["hqic"]))
        out = pd.DataFrame(recs, columns=["p", "nobs", "aic", "bic", "fpe", "hqic"])
        for k in reversed(keys):
            out.insert(0, k, row[k])
        return out

    res = gb.groupBy(*keys).applyInPandas(solve, schema)
    return res.drop(SERIES) if SERIES in keys else res


def var_residuals(df: DataFrame, cols: Sequence[str], coefs: DataFrame, p: int, idx: str = "idx",
                  size: int | None = None) -> DataFrame:
    """Residuals of a fitted VAR as a long table (variable, idx, value); the
    coefficients are applied as a JVM-side linear expression."""
    cols = list(cols)
    cf = {(r["equation"], r["regressor"]): r["coef"] for r in coefs.collect()}    # K*(Kp+1) numbers
    lg, _ = _wide_lag_design(df, cols, p, idx, [], size)
    lg = lg.where(F.col(idx) >= p)
    parts = []
    for c in cols:
        e = F.lit(cf[(c, "const")])
        for k in range(1, p + 1):
            for c2 in cols:
                e = e + F.lit(cf[(c, f"{c2}_lag{k}")]) * F.col(f"{c2}_lag{k}")
        parts.append(F.struct(F.lit(c).alias(V), (F.col(c) - e).alias("value")))
    return lg.select(idx, F.explode(F.array(*parts)).alias("_r")).select(F.col("_r.variable").alias(V), idx,
                                                                         F.col("_r.value").alias("value"))


def var_forecast(df: DataFrame, cols: Sequence[str], coefs: DataFrame, p: int, steps: int, idx: str = "idx",
                 alpha: float = 0.05, keys=()) -> DataFrame:
    """h-step VAR forecast with interval mean +- z * sqrt(diag(sum Psi_i Sigma Psi_i^T)),
    for every series of ``keys``.  Coefficients (as of :func:`var_fit`) and the
    last p rows of a series are joined into one row, over which an executor runs
    the recursion.  A series whose coefficients are incomplete has no rows."""
    cols = list(cols)
    K = len(cols)
    d0, keys = _with_series(df, keys)
    own = coefs.withColumn(SERIES, F.lit(0)) if SERIES in keys else coefs
    model = own.groupBy(*keys).agg(F.collect_list(F.struct("equation", "regressor", "coef")).alias("_c"))    # K(Kp + 1 + K) numbers
    ends = d0.groupBy(*keys).agg(F.max(idx).alias("_last"))
    tail = d0.join(ends, keys).where(F.col(idx) > F.col("_last") - max(p, 1)).groupBy(*keys, "_last").agg(
        F.array_sort(F.collect_list(F.struct(F.col(idx).cast("long").alias("i"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v")))).alias("_ys"))
    z = norm_ppf(1 - alpha / 2)

    def forecast(batches):
        for pdf in batches:
            recs = []
            for row in pdf.to_dict("records"):
                cf = {(e["equation"], e["regressor"]): e["coef"] for e in row["_c"]}
                hist = [np.asarray(e["v"], float) for e in row["_ys"]]
                if len(hist) < p or any(v is None or math.isnan(v) for v in cf.values()):
                    continue
                c = np.array([cf[e, "const"] for e in cols])
                A = [np.array([[cf[e, f"{c2}_lag{k}"] for c2 in cols] for e in cols]) for k in range(1, p + 1)]
                sigma = np.array([[cf[e, f"_sigma_{c2}"] for c2 in cols] for e in cols])
                psi, mse = [np.eye(K)], np.zeros((K, K))
                for h in range(steps):
                    if h:
                        psi.append(sum((A[k - 1] @ psi[h - k] for k in range(1, min(h, p) + 1)), np.zeros((K, K))))
                    yhat = c + sum((A[k - 1] @ hist[-k] for k in range(1, p + 1)), np.zeros(K))
                    hist.append(yhat)
                    mse = mse + psi[h] @ sigma @ psi[h].T
                    for i, v in enumerate(cols):
                        half = z * math.sqrt(max(mse[i, i], 0.0))
                        recs.append([row[k] for k in keys] + [v, int(row["_last"]) + 1 + h, float(yhat[i]), float(yhat[i] - half), float(yhat[i] + half)])
            yield pd.DataFrame(recs, columns=[*keys, V, idx, "mean", "lower", "upper"], dtype=None if recs else object)

    joined = model.join(tail, keys)
    out = joined.mapInPandas(forecast, f"{_key_schema(joined, keys)}, {V} string, `{idx}` long, mean double, lower double, upper double")
    return out.drop(SERIES) if SERIES in keys else out


# -------------------------------------------------------- walk-forward (prefix)

def walk_forward(df: DataFrame, cols: Sequence[str], p: int, split: int | float, idx: str = "idx",
                 targets: Sequence[str] | None = None, size: int | None = None, keys=()) -> DataFrame:
    """expanding-window one-step forecasts for every test row
    ``idx >= split`` of every series (``keys``): the model for row t is fitted
    on the rows < t of its series (AR(p) for one column, VAR(p) for several,
    constant included).  A ``split`` between 0 and 1 is a share of each series'
    own length; a series that is too short for the model has no test rows.

    Plan: prefix Gram matrices.  Rows are cut in blocks per series; one task
    per (series, block) computes its partial Gram; the carry (sum of earlier
    blocks of the series) comes from the small block table and meets the block
    by a cogroup, one carry row per block; within a block the running Grams of
    the test rows are solved in stacks.  Output (keys, variable, idx, observed,
    predicted, residual)."""
    cols = list(cols)
    targets = list(targets or cols)
    keys = _cols(keys)
    require(V not in keys, f"series key may not be named {V!r} (output column)")
    K = len(cols)
    least = p + K * p + 1                       # rows that the first fit needs
    share = 0 < split < 1
    require(share or split > least, "split too small for the model order")
    size = block_size(df.sparkSession, size)
    if share:
        lengths = df.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * F.lit(float(split))).alias("_from")) if keys else None
        if keys:
            lengths = lengths.select(*keys, F.when(F.col("_from") > least, F.col("_from")).otherwise(
                F.lit(2 ** 62)).alias("_from"))
        else:
            split = max(int(df.count() * split), 0)
            require(split > least, "split too small for the model order")
            share = False
    lg, _ = _wide_lag_design(df, cols, p, idx, keys, size)
    xcols = [f"{c}_lag{k}" for k in range(1, p + 1) for c in cols]
    design = lg.where(F.col(idx) >= p).select(
        *keys, idx, F.array(F.lit(1.0), *[F.col(c).cast("double") for c in xcols]).alias("_x"),
        F.array(*[F.col(c).cast("double") for c in targets]).alias("_y"))
    carry_from = lengths if share else None
    return prefix_forecasts(design, 1 + len(xcols), targets, split, idx, keys, size, carry_from)


def prefix_forecasts(design: DataFrame, mx: int, targets: Sequence[str], split: int | None, idx: str, keys: list, size: int,
                     starts: DataFrame | None = None) -> DataFrame:
    """Expanding-window forecasts of a regression of arrays ``_y`` on arrays
    ``_x`` (``mx`` regressors): every row from ``split`` on (or from the
    series' own ``_from`` in ``starts``) is predicted by the fit to the rows
    before it."""
    my, d = len(targets), mx + len(targets)
    share = starts is not None
    kschema = (_key_schema(design, keys) + ", ") if keys else ""
    design = add_blocks(design, idx, size).drop("_halo")

    # partial Gram of [x, y] per (series, block): one numpy Z^T Z per task
    tri = np.triu_indices(d)

    def block_gram(pdf: pd.DataFrame) -> pd.DataFrame:
        Z = np.hstack([np.vstack(pdf["_x"].to_numpy()), np.vstack(pdf["_y"].to_numpy())]).astype(float)
        out = pd.DataFrame({BLK: [int(pdf[BLK].iloc[0])], "_g": [(Z.T @ Z)[tri].tolist()]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    part = design.groupBy(*keys, BLK).applyInPandas(block_gram, f"{kschema}{BLK} long, _g array<double>")
    # carry = sum of the partial Grams of earlier blocks of the series (blocks x d(d+1)/2 rows)
    ex = part.select(*keys, BLK, F.posexplode("_g").alias("_k", "_s"))
    wb = Window.partitionBy(*keys, "_k").orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = ex.select(*keys, BLK, "_k", F.coalesce(F.sum("_s").over(wb), F.lit(0.0)).alias("_c"))
    carry = carry.groupBy(*keys, BLK).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_c"))),
                                                      lambda e: e["_c"]).alias("_carry"))
    if share:
        carry = carry.join(starts, keys)
    else:
        carry = carry.withColumn("_from", F.lit(int(split)).cast("long"))
    schema = f"{kschema}{V} string, {idx} long, observed double, predicted double"

    def run(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=[*keys, V, idx, "observed", "predicted"])
        rows = rows.sort_values(idx)
        at = rows[idx].to_numpy()
        Z = np.hstack([np.vstack(rows["_x"].to_numpy()), np.vstack(rows["_y"].to_numpy())]).astype(float)
        G = np.zeros((d, d))
        G[tri] = np.asarray(before["_carry"].iloc[0], dtype=float)
        G = G + np.triu(G, 1).T
        first = int(np.searchsorted(at, int(before["_from"].iloc[0])))
        G = G + Z[:first].T @ Z[:first]
        preds = []
        for lo in range(first, len(Z), STACK):
            z = Z[lo:lo + STACK]
            grams = np.cumsum(np.concatenate([G[None], z[:, :, None] * z[:, None, :]]), axis=0)
            preds.append(np.einsum("ni,nij->nj", z[:, :mx], stacked_ols(grams[:-1], mx)))
            G = grams[-1]
        pred = np.concatenate(preds) if preds else np.zeros((0, my))
        n = len(pred)
        out = pd.DataFrame({V: np.tile(np.array(targets, dtype=object), n), idx: np.repeat(at[first:], my),
                            "observed": Z[first:, mx:].ravel(), "predicted": pred.ravel()})
        for k in reversed(keys):
            out.insert(0, k, rows[k].iloc[0])
        return out

    out = design.groupBy(*keys, BLK).cogroup(carry.groupBy(*keys, BLK)).applyInPandas(run, schema)
    return out.withColumn("residual", F.col("observed") - F.col("predicted"))


# ---------------------------------------------------------------- ARMA (HR)

def _hr_initial_order(n: int, p: int, q: int) -> int:
    return max(2 * max(p, q, 1), min(int(round(math.log(n) ** 2)), n // 4))


def arma_design(long_y: DataFrame, P: int, Q: int, idx: str = "idx", value: str = "value",
                size: int | None = None, long_ar: int | None = None,
                ar_lags: Sequence[int] | None = None, ma_lags: Sequence[int] | None = None,
                fit_until: int | None = None):
    """Hannan-Rissanen stage 1: long AR(m) by OLS (Gram), residuals e_t as a
    JVM-side expression, then a design with y lags (1..P or ``ar_lags``) and
    e lags (1..Q or ``ma_lags``).  Returns (design frame, zcols, first usable
    idx, m)."""
    ar_lags = sorted(set(ar_lags)) if ar_lags is not None else list(range(1, P + 1))
    ma_lags = sorted(set(ma_lags)) if ma_lags is not None else list(range(1, Q + 1))
    n = long_y.count()
    # without MA terms no innovations are needed: every row counts
    m = long_ar or (_hr_initial_order(n, max(ar_lags, default=0), max(ma_lags, default=0)) if ma_lags else 0)
    lg = lagged(long_y.select(idx, value), [value], lags=range(1, m + 1), idx=idx, size=size)
    ycols = [f"{value}_lag{k}" for k in range(1, m + 1)]
    z1 = [F.lit(1.0)] + [F.col(c).cast("double") for c in ycols] + [F.col(value).cast("double")]
    rows = lg.where(F.col(idx) >= m)
    if fit_until is not None:
        rows = rows.where(F.col(idx) < fit_until)          # stage 1 sees the training rows only
    g = gram(rows.withColumn(SERIES, F.lit(0)), z1, [SERIES]).first()
    G = unpack(g["g"], m + 2)
    beta, _, _ = ols_from_gram(G, range(0, m + 1), [m + 1], int(g["n"]))
    fit = F.lit(float(beta[0, 0]))
    for k in range(1, m + 1):
        fit = fit + F.lit(float(beta[k, 0])) * F.col(f"{value}_lag{k}")
    res = lg.where(F.col(idx) >= m).select(idx, value, (F.col(value) - fit).alias("_e"))
    L = max(ar_lags + ma_lags, default=0)
    d2 = halo_lags(res, {value: ar_lags, "_e": ma_lags}, idx, size) if L else res
    zcols = [f"{value}_lag{k}" for k in ar_lags] + [f"_e_lag{k}" for k in ma_lags] + [value]
    return d2, zcols, m + L, m


def halo_lags(df: DataFrame, lags_by_col: dict, idx: str, size: int | None) -> DataFrame:
    """Only the listed lags of each column (one halo pass, halo = largest lag)."""
    from .ordering import halo_window
    L = max((max(v) for v in lags_by_col.values() if v), default=0)

    def exprs(w):
        return {f"{c}_lag{k}": F.lag(c, k).over(w) for c, ks in lags_by_col.items() for k in ks}

    return halo_window(df, exprs, idx, before=L, size=size)


def arma_grid(long_y: DataFrame, limit_p: int, limit_q: int, idx: str = "idx", value: str = "value",
              size: int | None = None) -> DataFrame:
    """information criteria of ARMA(p, q) for p < limit_p, q < limit_q
    (on an already differenced series).  One stage-1 fit, then one Gram over
    all y-lags and residual-lags; every cell is a sub-block solve on the common
    sample.  Criteria use the conditional Gaussian likelihood."""
    require(limit_p >= 1 and limit_q >= 1, "max p and max q must be >= 1")
    P, Q = limit_p - 1, limit_q - 1
    d2, zcols, start, _ = arma_design(long_y, P, Q, idx, value, size)
    z = [F.lit(1.0)] + [F.col(c) for c in zcols]
    g = gram(d2.where(F.col(idx) >= start).withColumn(SERIES, F.lit(0)), z, [SERIES]).first()
    mm = len(z)
    G, n = unpack(g["g"], mm), int(g["n"])
    recs = []
    for p in range(limit_p):
        for q in range(limit_q):
            xs = [0] + list(range(1, 1 + p)) + list(range(1 + P, 1 + P + q))
            _, ssr, _ = ols_from_gram(G, xs, [mm - 1], n)
            k = len(xs) + 1                      # + innovation variance
            llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(float(ssr[0]) / n) + 1.0)
            aic = -2 * llf + 2 * k
            aicc = aic + 2.0 * k * (k + 1) / max(n - k - 1, 1)
            bic = -2 * llf + k * math.log(n)
            recs.append((p, q, n, aic, aicc, bic))
    return long_y.sparkSession.createDataFrame(recs, "p int, q int, nobs long, aic double, aicc double, bic double")


def _with_constant(trend: str | None, default: bool) -> bool:
    require(trend in (None, "c", "n"), "trend must be 'c' or 'n'")
    return default if trend is None else trend == "c"


def _fit(G: np.ndarray, n: int, mm: int, constant: bool):
    """(coefficients with a 0 for a constant left out, ssr, their variances
    per unit of innovation variance, number of regressors)."""
    xs = list(range(0 if constant else 1, mm - 1))
    b, var = np.zeros(mm - 1), np.zeros(mm - 1)
    if not xs:
        return b, float(G[mm - 1, mm - 1]), var, 0
    beta, ssr, inv = ols_from_gram(G, xs, [mm - 1], n)
    b[xs], var[xs] = beta[:, 0], np.diag(inv)
    return b, float(ssr[0]), var, len(xs)


def arima_fit(long_y: DataFrame, p: int, d: int, q: int, idx: str = "idx", value: str = "value",
              size: int | None = None, trend: str | None = None) -> DataFrame:
    """ARIMA(p, d, q) by Hannan-Rissanen two-stage regression after
    ``d`` differences.  ``trend`` 'c' has a constant and 'n' none; by default
    there is one only without differencing.  Output: term, coef, std_err, plus sigma2 and the
    information criteria as extra rows."""
    from .transform import difference
    y = long_y.select(idx, value)
    if d:
        y = difference(y, [value], order=d, idx=idx, check=False)
    d2, zcols, start, _ = arma_design(y, p, q, idx, value, size)
    z = [F.lit(1.0)] + [F.col(c) for c in zcols]
    g = gram(d2.where(F.col(idx) >= start).withColumn(SERIES, F.lit(0)), z, [SERIES]).first()
    mm = len(z)
    G, n = unpack(g["g"], mm), int(g["n"])
    constant = _with_constant(trend, d == 0)
    b, ssr, var, kx = _fit(G, n, mm, constant)
    s2 = ssr / max(n - kx, 1)
    names = ["const"] + [f"ar{k}" for k in range(1, p + 1)] + [f"ma{k}" for k in range(1, q + 1)]
    k = kx + 1
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1.0)
    recs = [(nm, float(b[i]), float(math.sqrt(max(s2 * var[i], 0.0)))) for i, nm in enumerate(names) if i or constant]
    recs += [("sigma2", ssr / n, None), ("aic", -2 * llf + 2 * k, None),
             ("bic", -2 * llf + k * math.log(n), None), ("nobs", float(n), None)]
    return long_y.sparkSession.createDataFrame(recs, "term string, coef double, std_err double")


# ------------------------------------------------ seasonal ARIMA + forecast

def _poly_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.convolve(a, b)


def _diff_poly(d: int, D: int, s: int) -> np.ndarray:
    poly = np.array([1.0])
    for _ in range(d):
        poly = _poly_mul(poly, np.array([1.0, -1.0]))
    for _ in range(D):
        seas = np.zeros(s + 1)
        seas[0], seas[s] = 1.0, -1.0
        poly = _poly_mul(poly, seas)
    return poly


def sarima_lags(order: tuple, seasonal: tuple | None) -> tuple[list[int], list[int], int, int, int]:
    """Lag sets of the multiplicative model, estimated with unrestricted
    coefficients: AR {1..p} u {s*i} u {j + s*i}, MA likewise; plus (d, D, s)."""
    p, d, q = order
    P, D, Q, s = seasonal if seasonal else (0, 0, 0, 0)
    ar = {k for k in range(1, p + 1)}
    ma = {k for k in range(1, q + 1)}
    if s:
        ar |= {s * i + j for i in range(1, P + 1) for j in range(0, p + 1)}
        ma |= {s * i + j for i in range(1, Q + 1) for j in range(0, q + 1)}
    return sorted(ar), sorted(ma), d, D, s


def _sarima_core(long_y: DataFrame, order: tuple, seasonal: tuple | None, idx: str, value: str,
                 size: int | None, fit_until: int | None = None, trend: str | None = None) -> dict:
    constant = _with_constant(trend, False)
    if seasonal and seasonal[3] and tuple(order) == (0, 0, 0):
        order = (1, 0, 0)
    ar, ma, d, D, s = sarima_lags(tuple(order), tuple(seasonal) if seasonal else None)
    y = long_y.select(idx, F.col(value).cast("double").alias(value))
    dpoly = _diff_poly(d, D, s)
    k0 = len(dpoly) - 1
    if k0:
        from .ordering import halo_window

        def ex(w):
            e = F.col(value)
            for k in range(1, k0 + 1):
                if dpoly[k] != 0:
                    e = e + F.lit(float(dpoly[k])) * F.lag(value, k).over(w)
            return {value: e}

        wser = halo_window(y, ex, idx, before=k0, size=size).where(F.col(idx) >= k0).withColumn(
            idx, F.col(idx) - F.lit(k0))
    else:
        wser = y
    wfit = None if fit_until is None else fit_until - k0
    d2, zcols, start, _ = arma_design(wser, 0, 0, idx, value, size, ar_lags=ar, ma_lags=ma, fit_until=wfit)
    z = [F.lit(1.0)] + [F.col(c) for c in zcols]
    rows = d2.where(F.col(idx) >= start)
    if wfit is not None:
        rows = rows.where(F.col(idx) < wfit)
    g = gram(rows.withColumn(SERIES, F.lit(0)), z, [SERIES]).first()
    mm = len(z)
    G, n = unpack(g["g"], mm), int(g["n"])
    b, ssr, var, kx = _fit(G, n, mm, constant)
    return dict(ar=ar, ma=ma, dpoly=dpoly, k0=k0, y=y, d2=d2, zcols=zcols, start=start, b=b, ssr=ssr, var=var, n=n, kx=kx,
                constant=constant)


def sarima_one_step(long_y: DataFrame, order: tuple, seasonal: tuple | None, split: int, idx: str = "idx",
                    value: str = "value", size: int | None = None, trend: str | None = None) -> DataFrame:
    """One-step predictions of y for rows ``idx >= split``, the model refitted
    at every step: the regression on value and innovation lags is an expanding
    one (prefix Grams); the long autoregression that estimates the innovations
    is fitted once, on the rows before ``split``.  In differenced space the
    prediction is the fitted regression; back in y, ``y_hat = w_hat + (y - w)``.
    Output (idx, observed, predicted, residual)."""
    c = _sarima_core(long_y, order, seasonal, idx, value, size, fit_until=split, trend=trend)
    zcols, k0 = c["zcols"], c["k0"]
    x = ([F.lit(1.0)] if c["constant"] else []) + [F.col(z) for z in zcols[:-1]]
    rows = c["d2"].where(F.col(idx) >= c["start"])
    if not x:                                   # nothing to fit: the differenced series is predicted by 0
        pw = rows.where(F.col(idx) >= split - k0).select((F.col(idx) + F.lit(k0)).alias(idx), F.col(value).alias("residual"))
    else:
        require(split - k0 > c["start"] + len(x), "split too small for the model order")
        design = rows.select(idx, F.array(*x).alias("_x"), F.array(F.col(value)).alias("_y"))
        wf = prefix_forecasts(design, len(x), [value], split - k0, idx, [], block_size(long_y.sparkSession, size))
        pw = wf.select((F.col(idx) + F.lit(k0)).alias(idx), "residual")
    out = c["y"].where(F.col(idx) >= split).join(pw, idx)
    return out.select(idx, F.col(value).alias("observed"), (F.col(value) - F.col("residual")).alias("predicted"),
                      "residual")


def sarima(long_y: DataFrame, order: tuple = (1, 0, 0), seasonal: tuple | None = None, steps: int = 0,
           alpha: float = 0.05, idx: str = "idx", value: str = "value", size: int | None = None,
           trend: str | None = None):
    """(seasonal) ARIMA by Hannan-Rissanen regressions on the
    differenced series ``(1-L)^d (1-L^s)^D y``, and an h-step forecast of y
    with interval ``mean +- z sigma sqrt(sum psi_j^2)`` where psi are the
    weights of ``theta(L) / (phi(L) (1-L)^d (1-L^s)^D)``.  A seasonal order
    without a non-seasonal one uses AR(1), as the reference's model does.
    ``trend`` 'c' adds a constant to the differenced equation; by default
    there is none, so forecasts of a differenced series don't drift.
    Returns (coefficients, forecast or None)."""
    spark = long_y.sparkSession
    c = _sarima_core(long_y, order, seasonal, idx, value, size, trend=trend)
    ar, ma, dpoly, y, d2, zcols = c["ar"], c["ma"], c["dpoly"], c["y"], c["d2"], c["zcols"]
    b, n, var = c["b"], c["n"], c["var"]
    sigma2 = c["ssr"] / n
    s2 = c["ssr"] / max(n - c["kx"], 1)
    names = ["const"] + [f"ar_L{k}" for k in ar] + [f"ma_L{k}" for k in ma]
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(sigma2) + 1.0)
    kpar = c["kx"] + 1
    recs = [(nm, float(b[i]), float(math.sqrt(max(s2 * var[i], 0.0)))) for i, nm in enumerate(names) if i or c["constant"]]
    recs += [("sigma2", sigma2, None), ("aic", -2 * llf + 2 * kpar, None),
             ("bic", -2 * llf + kpar * math.log(n), None), ("nobs", float(n), None)]
    coefs = spark.createDataFrame(recs, "term string, coef double, std_err double")
    if not steps:
        return coefs, None
    # polynomials on y: a_y(L) = (1 - sum phi_k L^k) (1-L)^d (1-L^s)^D ; theta(L) = 1 + sum theta_k L^k
    aw = np.zeros(max(ar, default=0) + 1)
    aw[0] = 1.0
    for i, k in enumerate(ar):
        aw[k] -= b[1 + i]
    ay = _poly_mul(aw, dpoly)
    th = np.zeros(max(ma, default=0) + 1)
    th[0] = 1.0
    for i, k in enumerate(ma):
        th[k] += b[1 + len(ar) + i]
    N = y.agg(F.max(idx)).first()[0]
    p_y = len(ay) - 1
    hist = [r[value] for r in y.where(F.col(idx) > N - p_y - 1).orderBy(idx).collect()] if p_y else []
    # last residuals of the fitted w-equation (bounded by the largest MA lag)
    qm = max(ma, default=0)
    fitted = F.lit(float(b[0]))
    for i, col in enumerate(zcols[:-1]):
        fitted = fitted + F.lit(float(b[1 + i])) * F.col(col)
    nw = d2.agg(F.max(idx)).first()[0]
    eres = [r["_r"] for r in d2.where(F.col(idx) > nw - qm).orderBy(idx).select(
        (F.col(value) - fitted).alias("_r")).collect()] if qm else []
    ys = list(hist)
    es = list(eres)
    psi = [1.0]
    for j in range(1, steps):
        v = th[j] if j < len(th) else 0.0
        for k in range(1, min(j, p_y) + 1):
            v += -ay[k] * psi[j - k]
        psi.append(v)
    zq = norm_ppf(1 - alpha / 2)
    out = []
    for h in range(steps):
        mean = float(b[0])
        for k in range(1, p_y + 1):
            mean += -ay[k] * ys[-k]
        for k in range(1, qm + 1):
            if k <= len(es) and len(th) > k:
                mean += th[k] * es[-k]
        ys.append(mean)
        es.append(0.0)
        sd = math.sqrt(sigma2 * sum(x * x for x in psi[: h + 1]))
        mean = float(mean)
        out.append((int(N + 1 + h), mean, mean - zq * sd, mean + zq * sd))
    fc = spark.createDataFrame(out, f"{idx} long, mean double, lower double, upper double")
    return coefs, fc

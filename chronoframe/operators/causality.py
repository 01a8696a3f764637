"""PCMCI causal discovery with partial-correlation tests (Runge et al. 2019).

Every test of the algorithm is a partial correlation between lagged
variables, i.e. a function of the covariance of ``X_k(t-s)`` for all
variables k and lags s = 0..2*tau_max.  That covariance comes from one Gram
aggregate over the series (rows t >= 2*tau_max, so all tests share one
sample); the PC1 parent search, the MCI tests, the Student-t p-values and the
FDR correction are tables from there on.  The covariance is stored as rows; a
group of the PC1 search gets the slice of one target; an MCI test is a row that
an equi-join gives the few entries it needs; the p-values are corrected by the
distributed ``bh_correct``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gram import unpack
from ..functions.stats import t_sf
from ..session import cut_lineage
from .linear import SERIES, _key_schema, _wide_lag_design, _with_series, bh_correct, gram
from .validate import require

PC_ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)


def _parcorr(C: np.ndarray, n: int, a: int, b: int, Z: list[int]) -> tuple[float, float]:
    idx = [a, b] + [z for z in Z if z not in (a, b)]
    S = C[np.ix_(idx, idx)]
    try:
        P = np.linalg.inv(S)
    except np.linalg.LinAlgError:
        P = np.linalg.pinv(S)
    den = math.sqrt(max(P[0, 0] * P[1, 1], 1e-300))
    r = float(np.clip(-P[0, 1] / den, -1.0, 1.0))
    dof = n - 2 - (len(idx) - 2)
    if dof <= 0:
        return r, float("nan")
    if abs(r) >= 1.0:
        return r, 0.0
    t = r * math.sqrt(dof / (1.0 - r * r))
    return r, min(1.0, 2.0 * t_sf(abs(t), dof))


def _residual_ssr(C: np.ndarray, n: int, y: int, X: list[int]) -> float:
    if not X:
        return float(C[y, y] * n)
    Sxx = C[np.ix_(X, X)]
    Sxy = C[np.ix_(X, [y])]
    beta = np.linalg.pinv(Sxx) @ Sxy
    return float((C[y, y] - (Sxy.T @ beta)[0, 0]) * n)


def _covariance_rows(g: DataFrame, keys: list[str], m: int) -> DataFrame:
    """keys, n, a, c: row ``a`` of the covariance of the lagged variables from its
    diagonal on (columns count from 1; column 0 of the Gram is the constant)."""
    n, at = F.col("n").cast("double"), F.col("g")

    def row(a):
        start = (a * (2 * m - a + 1) / 2).cast("int")           # of row a in the triangle
        c = F.transform(F.sequence(a, F.lit(m - 1)), lambda b: F.get(at, start + b - a) / n - F.get(at, a) / n * (F.get(at, b) / n))
        return F.struct(a.alias("a"), c.alias("c"))
    rows = g.select(*keys, "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(m - 1)), row)).alias("_r"))
    return cut_lineage(rows.select(*keys, "n", "_r.a", "_r.c").repartition(*keys, "a"))


def _parents(rows: DataFrame, keys: list[str], K: int, tau_max: int, pc_alpha: float | None) -> DataFrame:
    """keys, target, parents (columns of the Gram): one PC1 search per group,
    which holds the target's slice of the covariance and no more."""
    first, last = K + 1, K + K * tau_max        # columns of the candidates: lags 1 .. tau_max
    cand = rows.where(F.col("a").between(first, last)).select(
        *keys, "n", "a", F.slice("c", F.lit(1), F.lit(last) - F.col("a") + 1).alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("target"))
    own = rows.where(F.col("a") <= K).select(   # the target's variance and its covariance with the candidates
        *keys, "n", "a", F.concat(F.slice("c", 1, 1), F.slice("c", F.lit(first + 1) - F.col("a"), F.lit(last - first + 1))).alias("c"),
        (F.col("a") - 1).alias("target"))
    cands = [(i, s) for s in range(1, tau_max + 1) for i in range(K)]

    def search(pdf):
        d = len(cands)
        C = np.zeros((d + 1, d + 1))
        j, n = int(pdf["target"].iloc[0]), int(pdf["n"].iloc[0])
        for a, c in zip(pdf["a"].tolist(), pdf["c"]):
            if a <= K:
                C[0] = C[:, 0] = np.asarray(c, float)
            else:
                C[a - first + 1, a - first + 1:] = C[a - first + 1:, a - first + 1] = np.asarray(c, float)
        place = {(j, 0): 0} | {p: 1 + k for k, p in enumerate(cands)}
        found = _pc1_best(C, n, j, cands, pc_alpha, lambda i, s: place[i, s])
        out = pd.DataFrame({"target": [j], "parents": [[1 + s * K + i for i, s in found]]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = _key_schema(rows, keys)
    return cut_lineage(cand.unionByName(own).groupBy(*keys, "target").applyInPandas(search, f"{kinds}, target int, parents array<int>"))


def _tests_as_rows(g: DataFrame, keys: list[str], cols: list[str], tau_max: int, pc_alpha: float | None) -> DataFrame:
    """keys, source, target, lag, val, p_value: every test is a row that joins
    the covariance entries it needs."""
    K, L = len(cols), 2 * tau_max
    rows = _covariance_rows(g, keys, 1 + K * (L + 1))
    parents = _parents(rows, keys, K, tau_max, pc_alpha)

    # a test is a row: columns x (source, lag) and y (target), and what is held fixed
    sources = parents.select(*keys, F.col("target").alias("i"), F.col("parents").alias("_pi"))
    lags = F.explode(F.sequence(F.lit(0), F.lit(tau_max))).alias("lag")
    tests = parents.select(*keys, F.col("target").alias("j"), F.col("parents").alias("_pj")).join(sources, keys).select("*", lags)
    tests = tests.where((F.col("lag") > 0) | (F.col("i") != F.col("j")))
    x, y = F.lit(1) + F.col("lag") * K + F.col("i"), F.lit(1) + F.col("j")
    shifted = F.filter(F.transform("_pi", lambda p: p + F.col("lag") * K), lambda p: p <= K + L * K)
    tests = tests.withColumns({"x": x, "y": y}).withColumn("fixed", F.array_except(F.array_union("_pj", shifted), F.array("x", "y")))
    tests = cut_lineage(tests.select(*keys, "i", "j", "lag", "x", "y", "fixed"))

    # the entries that a test needs, by an equi-join
    used = F.sort_array(F.array_union(F.array("x", "y"), F.col("fixed")))
    pairs = tests.select(*keys, "i", "j", "lag", F.explode(used).alias("a"), used.alias("_u")).select(
        *keys, "i", "j", "lag", "a", F.explode(F.filter("_u", lambda b: b >= F.col("a"))).alias("b"))
    entries = rows.select(*keys, "n", "a", F.posexplode("c").alias("_o", "c")).select(
        *keys, "n", "a", (F.col("a") + F.col("_o")).alias("b"), "c")
    slices = pairs.join(entries, [*keys, "a", "b"]).groupBy(*keys, "i", "j", "lag", "n").agg(
        F.collect_list(F.struct("a", "b", "c")).alias("_c"))
    solved = slices.join(tests, [*keys, "i", "j", "lag"])

    def correlate(batches):
        for pdf in batches:
            val, p = [], []
            for entry, n, a, b, fixed in zip(pdf["_c"], pdf["n"], pdf["x"], pdf["y"], pdf["fixed"]):
                place = {c: k for k, c in enumerate([a, b, *fixed])}
                C = np.zeros((len(place), len(place)))
                for e in entry:
                    C[place[e["a"]], place[e["b"]]] = C[place[e["b"]], place[e["a"]]] = e["c"]
                r, q = _parcorr(C, int(n), 0, 1, list(range(2, len(place))))
                val.append(r)
                p.append(None if math.isnan(q) else q)
            out = pdf[[*keys]].copy()
            out["source"], out["target"] = [cols[i] for i in pdf["i"]], [cols[j] for j in pdf["j"]]
            out["lag"], out["val"], out["p_value"] = pdf["lag"], val, np.array(p, float)
            yield out

    schema = _key_schema(rows, keys) + ", source string, target string, lag int, val double, p_value double"
    return solved.mapInPandas(correlate, schema)


def _tests_by_series(g: DataFrame, keys: list[str], cols: list[str], tau_max: int, pc_alpha: float | None) -> DataFrame:
    """The same in one group per series."""
    K, L = len(cols), 2 * tau_max
    cands = [(i, s) for s in range(1, tau_max + 1) for i in range(K)]
    col = lambda k, s: s * K + k                                # noqa: E731

    def run(pdf):
        G, n = unpack(pdf["g"].iloc[0], 1 + K * (L + 1)), int(pdf["n"].iloc[0])
        mu = G[0, 1:] / n
        C = G[1:, 1:] / n - np.outer(mu, mu)
        parents = [_pc1_best(C, n, j, cands, pc_alpha, col) for j in range(K)]
        recs = []
        for i, j, lag in ((i, j, lag) for j in range(K) for i in range(K) for lag in range(tau_max + 1) if lag or i != j):
            fixed = {*parents[j], *((k, s + lag) for k, s in parents[i] if s + lag <= L)} - {(i, lag), (j, 0)}
            recs.append((cols[i], cols[j], lag, *_parcorr(C, n, col(i, lag), col(j, 0), [col(k, s) for k, s in sorted(fixed)])))
        out = pd.DataFrame(recs, columns=["source", "target", "lag", "val", "p_value"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return g.groupBy(*keys).applyInPandas(run, _key_schema(g, keys) + ", source string, target string, lag int, val double, p_value double")


def pcmci(df: DataFrame, cols: Sequence[str], tau_max: int = 8, pc_alpha: float | None = None,
          alpha_level: float = 0.01, fdr: bool = True, fdr_contemporaneous: bool = False,
          idx: str = "idx", keys=(), size: int | None = None, fanout: bool = True) -> DataFrame:
    """PCMCI with ParCorr.  Output per series: (source, target, lag, val,
    p_value, q_value, significant) for lags 0..tau_max (lag 0 = contemporaneous,
    source != target).  ``pc_alpha=None`` picks the PC1 level per target from
    ``PC_ALPHAS`` by the AIC of the target regressed on its parents; q-values
    are Benjamini-Hochberg over the lagged links (and lag 0 when
    ``fdr_contemporaneous``).  ``fanout=False`` searches and tests a series in
    one group, which saves shuffles for many short series of few variables."""
    cols = list(cols)
    K = len(cols)
    require(K >= 2, "PCMCI needs at least two variables")
    d0, keys = _with_series(df, keys)
    L = 2 * tau_max
    lg, zcols = _wide_lag_design(d0, cols, L, idx, keys, size)
    z = [F.lit(1.0)] + [F.col(c).cast("double") for c in zcols]
    g = gram(lg.where(F.col(idx) >= L), z, keys)
    tested = _tests_as_rows if fanout else _tests_by_series
    res = cut_lineage(tested(g, keys, cols, tau_max, pc_alpha))
    family = F.col("p_value").isNotNull() & (F.col("lag") >= (0 if fdr_contemporaneous else 1)) & F.lit(fdr)
    adjusted = bh_correct(res.where(family), "p_value", keys, size=size)
    res = adjusted.select(*res.columns, "q_value").unionByName(res.where(~family).withColumn("q_value", F.col("p_value")))
    res = res.withColumn("significant", F.coalesce(F.col("q_value") <= alpha_level, F.lit(False)))
    return res.drop(SERIES) if SERIES in keys else res


def _pc1_best(C, n, j, cands, pc_alpha, col):
    """PC1 parents of target j; with ``pc_alpha=None`` the level from
    ``PC_ALPHAS`` whose parent set gives the lowest AIC of the target."""
    best = None
    for a in ([pc_alpha] if pc_alpha is not None else PC_ALPHAS):
        par = _pc1(C, n, j, cands, a, col)
        ssr = _residual_ssr(C, n, col(j, 0), [col(i, s) for i, s in par])
        score = n * math.log(max(ssr, 1e-300)) + 2 * len(par)
        if best is None or score < best[0]:
            best = (score, par)
    return best[1]


def _pc1(C, n, j, cands, alpha, col):
    """PC1 parent search for target j: condition sets of growing size built
    from the strongest remaining parents; a candidate is dropped once a test
    gives p > alpha."""
    parents = list(cands)
    strength = {p: math.inf for p in parents}
    dim = 0
    while len(parents) - 1 >= dim:
        drop = []
        for p in parents:
            others = [q for q in parents if q != p][:dim]
            val, pv = _parcorr(C, n, col(*p), col(j, 0), [col(*q) for q in others])
            strength[p] = min(strength[p], abs(val))
            if not (pv <= alpha):
                drop.append(p)
        parents = [p for p in parents if p not in drop]
        parents.sort(key=lambda p: -strength[p])
        dim += 1
    return parents


def parse_links(links: DataFrame, keys=()) -> DataFrame:
    """Source -> target when any lag slot (slot 0 = contemporaneous) is significant."""
    k = list(keys)
    return links.groupBy(*k, "source", "target").agg(
        F.bool_or("significant").alias("edge"), F.min("q_value").alias("q_value"))

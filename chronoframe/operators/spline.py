"""Global interpolating splines over series of any length.

The spline of degree k through all observed points of a series is one banded
linear system: row j says that the B-splines around x_j add up to y_j.  The
system is solved by substructuring.  A block of consecutive observations is
eliminated on its own, which leaves a linear relation between its first and last
k coefficients (its edges) and the neighbours' edges; two neighbouring relations
combine into one, so relations of relations are formed, a fixed number at a
time, until one is left, and the edges are substituted back down the same tree.
A series of one block has no neighbours; such series are filled many at a time.
No call ever holds more than one block of a long series, or one group of edges.
The collocation matrix is totally positive, so that elimination needs no
pivoting across blocks.

Knots are the "not-a-knot" ones: observed points for odd degrees, midpoints for
even ones, without those next to the ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import block_size, cut_lineage
from .groups import map_groups
from .ordering import _cols, blocked_cumsum
from .validate import require

LEAF = 32                                       # unknowns eliminated in one dense solve
GROUP = 256                                     # edge relations combined in one task
VAR = "_var"


# -- relations between edges -----------------------------------------------
# a relation (f, L, R): [first k; last k] = f - L @ (last k of the left neighbour) - R @ (first k of the right one)

def _combine(f, L, R, k: int):
    """Relations of the pairs (0, 1), (2, 3), ... of an even number of relations,
    and how their inner edges follow from the outer ones."""
    p, q = slice(0, None, 2), slice(1, None, 2)
    n = len(f) // 2
    eye = np.eye(k)
    m = np.zeros((n, 2 * k, 2 * k))
    m[:, :k, :k] = m[:, k:, k:] = eye
    m[:, :k, k:], m[:, k:, :k] = R[p][:, k:], L[q][:, :k]
    rhs = np.zeros((n, 2 * k, 1 + 2 * k))
    rhs[:, :k, 0], rhs[:, k:, 0] = f[p][:, k:], f[q][:, :k]
    rhs[:, :k, 1:1 + k], rhs[:, k:, 1 + k:] = -L[p][:, k:], -R[q][:, :k]
    inner = np.linalg.solve(m, rhs)             # [last of p; first of q] from 1, left and right
    ip, iq = inner[:, :k], inner[:, k:]
    first, last = -R[p][:, :k] @ iq, -L[q][:, k:] @ ip
    first[:, :, 0] += f[p][:, :k]
    first[:, :, 1:1 + k] -= L[p][:, :k]
    last[:, :, 0] += f[q][:, k:]
    last[:, :, 1 + k:] -= R[q][:, k:]
    both = np.concatenate([first, last], axis=1)
    return (both[:, :, 0], -both[:, :, 1:1 + k], -both[:, :, 1 + k:]), inner


def _up(f, L, R, k: int):
    """Combine neighbouring relations into one; the inner edges level by level."""
    levels = []
    while len(f) > 1:
        even = len(f) // 2 * 2
        (g, M, S), inner = _combine(f[:even], L[:even], R[:even], k)
        levels.append((len(f), inner))
        f, L, R = np.concatenate([g, f[even:]]), np.concatenate([M, L[even:]]), np.concatenate([S, R[even:]])
    return (f[0], L[0], R[0]), levels


def _down(levels, left: np.ndarray, right: np.ndarray, k: int):
    """Neighbours' edges (left, right) of every relation, from those of all together."""
    left, right = left[None], right[None]
    for count, inner in reversed(levels):
        n = count // 2
        a, b = left[:n], right[:n]
        at = inner[:, :, 0] + (inner[:, :, 1:1 + k] @ a[:, :, None] + inner[:, :, 1 + k:] @ b[:, :, None])[:, :, 0]
        new_left, new_right = np.empty((count, k)), np.empty((count, k))
        new_left[:2 * n:2], new_right[:2 * n:2] = a, at[:, k:]
        new_left[1:2 * n:2], new_right[1:2 * n:2] = at[:, :k], b
        new_left[2 * n:], new_right[2 * n:] = left[n:], right[n:]
        left, right = new_left, new_right
    return left, right


# -- one block of observations ---------------------------------------------

class Block:
    """Observations ``r0 .. r1 - 1`` of a series of ``n``, with the halo that the
    knots around them need: ranks from ``first`` on, at ``x``."""

    def __init__(self, k: int, n: int, r0: int, r1: int, first: int, x: np.ndarray):
        self.k, self.n, self.r0, self.r1 = k, n, r0, r1
        # the knots t[lo] .. t[hi - 1] around the block
        self.lo, self.hi = max(r0 - 2 * k - 1, 0), min(r1 + 2 * k + 2, n + k + 1)
        j = np.arange(self.lo, self.hi)
        at = lambda r: x[np.clip(r, 0, n - 1) - first]          # noqa: E731
        rank = np.where(j <= k, 0, np.where(j >= n, n - 1, j - (k + 1) // 2))
        if k % 2:
            self.t = at(rank)
        else:
            inside = (j > k) & (j < n)
            rank = np.where(inside, j - k // 2 - 1, rank)
            self.t = np.where(inside, (at(rank) + at(np.where(inside, rank + 1, rank))) / 2, at(rank))

    def basis(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first of the k + 1 B-splines, their values) at every x;
        beyond the ends those of the last polynomial."""
        k, t = self.k, self.t
        m = np.clip(np.searchsorted(t, x, side="right") - 1 + self.lo, k, self.n - 1) - self.lo
        b = np.zeros((len(x), k + 1))
        b[:, 0] = 1.0
        for d in range(1, k + 1):
            saved = np.zeros(len(x))
            for i in range(d):
                right, left = t[m + i + 1] - x, x - t[m + 1 - d + i]
                part = b[:, i] / (right + left)
                b[:, i] = saved + right * part
                saved = left * part
            b[:, d] = saved
        return m + self.lo - k, b

    def leaves(self, x: np.ndarray, y: np.ndarray):
        """Eliminate runs of ``LEAF`` observations (the last one may have up to
        twice as many): their relations, and the solves behind them."""
        k, size = self.k, self.r1 - self.r0
        start, value = self.basis(x)
        count = max(1, size // LEAF)
        edges = [i * LEAF for i in range(count)] + [size]
        parts, f, L, R = [], [], [], []
        whole = count - 1
        for lo, hi, rows in ([(0, whole * LEAF, LEAF)] if whole else []) + [(edges[-2], size, size - edges[-2])]:
            many = (hi - lo) // rows
            a = np.zeros((many, rows, rows + 2 * k))
            i = np.arange(lo, hi)
            of, row = (i - lo) // rows, (i - lo) % rows
            first = start[lo:hi] - (self.r0 + lo + of * rows - k)
            for c in range(k + 1):
                use = value[lo:hi, c] != 0
                a[of[use], row[use], first[use] + c] = value[lo:hi, c][use]
            rhs = np.concatenate([y[lo:hi].reshape(many, rows, 1), a[:, :, :k], a[:, :, rows + k:]], axis=2)
            sol = np.linalg.solve(a[:, :, k:rows + k], rhs)     # own coefficients from 1, left and right
            parts.append(sol)
            edge = np.concatenate([sol[:, :k], sol[:, rows - k:]], axis=1)
            f.append(edge[:, :, 0]), L.append(edge[:, :, 1:1 + k]), R.append(edge[:, :, 1 + k:])
        return parts, np.concatenate(f), np.concatenate(L), np.concatenate(R)

    def relation(self, x, y):
        return _up(*self.leaves(x, y)[1:], self.k)[0]

    def coefficients(self, x, y, left, right) -> np.ndarray:
        """Coefficients r0 - k .. r1 + k - 1."""
        parts, f, L, R = self.leaves(x, y)
        a, b = _down(_up(f, L, R, self.k)[1], left, right, self.k)
        own, at = [left], 0
        for sol in parts:
            many, k = len(sol), self.k
            c = sol[:, :, 0] - (sol[:, :, 1:1 + k] @ a[at:at + many, :, None] + sol[:, :, 1 + k:] @ b[at:at + many, :, None])[:, :, 0]
            own.append(c.ravel())
            at += many
        return np.concatenate([*own, right])


# -- the job ---------------------------------------------------------------

def _block_of(pdf: pd.DataFrame, k: int, size: int) -> tuple[Block, np.ndarray, np.ndarray]:
    """The block and its own observations, from its rows and halo copies."""
    obs = pdf[pdf["_y"].notna()].sort_values("_rank")
    n, b = int(pdf["_n"].iloc[0]), int(pdf["_b"].iloc[0])
    last = max(n // size - 1, 0)
    r0, r1 = b * size, n if b >= last else (b + 1) * size
    rank, x, y = obs["_rank"].to_numpy(), obs["_x"].to_numpy(float), obs["_y"].to_numpy(float)
    own = (rank >= r0) & (rank < r1)
    return Block(k, n, r0, r1, int(rank[0]), x), x[own], y[own]


def _flat(relation) -> dict:
    return {name: [a.ravel().tolist()] for name, a in zip(("f", "l", "r"), relation)}


def _stack(pdf: pd.DataFrame, k: int):
    return (np.stack(pdf["f"]).reshape(-1, 2 * k), np.stack(pdf["l"]).reshape(-1, 2 * k, k), np.stack(pdf["r"]).reshape(-1, 2 * k, k))


def spline_interpolate(df: DataFrame, cols: Sequence[str], order: int = 3, idx: str = "idx", keys=(),
                       size: int | None = None, group: int = GROUP) -> DataFrame:
    """I2, orders 1 to 5: fill the gaps of every column with the spline of degree
    ``order`` through all of its observed values, per series of ``keys``.

    A leading gap stays missing; a trailing one continues the last polynomial.  A
    column with fewer than ``order`` + 1 observations stays as it is.  ``idx`` is
    unique in its series.  ``size`` rows are eliminated in one task (at least
    4 * order + 4), and ``group`` edge relations."""
    require(1 <= order <= 5, "order must be in 1..5")
    keys, k = _cols(keys), order
    size = max(block_size(df.sparkSession, size), 4 * k + 4)
    halo = 2 * k + 3
    g = [*keys, VAR]
    long = df.select(*keys, idx, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([*keys, idx], list(cols), VAR, "_y")
    run = blocked_cumsum(long.withColumn("_obs", F.col("_y").isNotNull().cast("long")), ["_obs"], idx, g, size)
    n = run.groupBy(*g).agg(F.max("_obs_cum").alias("_n")).where(F.col("_n") > k)
    last = F.greatest(F.floor(F.col("_n") / size) - 1, F.lit(0))
    ranked = run.where(F.col("_obs_cum") > 0).join(n, g).select(
        *g, "_n", F.col(idx), F.col(idx).cast("double").alias("_x"), "_y", (F.col("_obs_cum") - 1).alias("_rank"))
    own = F.least(F.floor(F.col("_rank") / size), last)
    # observations near a block's edge also go to the neighbour, for its knots
    reach = F.array_distinct(F.array(own, *[F.greatest(F.lit(0), F.least(F.floor((F.col("_rank") + d) / size), last)) for d in (-halo, halo)]))
    blocks = F.when(F.col("_y").isNotNull(), reach).otherwise(F.array(own))
    dealt = cut_lineage(ranked.withColumn("_own", own).withColumn("_b", F.explode(blocks)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*g).schema)
    kind = df.schema[idx].dataType.simpleString()
    filled = f"{kinds}, `{idx}` {kind}, _fill double"
    nothing = np.zeros(k)

    def whole(table, starts):
        gap = table.column("_y").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        x, y, n = (table.column(c).to_numpy() for c in ("_x", "_y", "_n"))
        fills = np.full(len(x), np.nan)
        for lo, hi in zip(starts, [*starts[1:], len(x)]):
            own = ~gap[lo:hi]
            if own.all():
                continue
            at, seen = x[lo:hi][~own], x[lo:hi][own]
            block = Block(k, int(n[lo]), 0, int(n[lo]), 0, seen)
            c = block.coefficients(seen, y[lo:hi][own], nothing, nothing)
            start, value = block.basis(at)
            fills[lo + np.flatnonzero(~own)] = (c[start[:, None] + np.arange(k + 1) + k] * value).sum(axis=1)
        rows = table.take(np.flatnonzero(gap))
        return {c: rows.column(c) for c in (*g, idx)} | {"_fill": fills[gap]}

    short = F.col("_n") < 2 * size              # one block
    fills = map_groups(dealt.where(short), g, ["_rank"], whole, filled)
    if dealt.agg(F.max("_b")).first()[0]:       # one number
        fills = fills.unionByName(_fill_blocks(dealt.where(~short), k, size, group, g, idx, kinds, filled))
    wide = fills.groupBy(*keys, idx).agg(*[F.max(F.when(F.col(VAR) == c, F.col("_fill"))).alias(f"_fill_{c}") for c in cols])
    out = df.join(wide, [*keys, idx], "left")
    return out.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def _fill_blocks(dealt: DataFrame, k: int, size: int, group: int, g: list[str], idx: str, kinds: str, filled: str) -> DataFrame:
    """Values for the gaps of series of several blocks."""
    relation = f"{kinds}, _b long, f array<double>, l array<double>, r array<double>"
    edges = f"{kinds}, _b long, a array<double>, z array<double>"

    def key_of(pdf):
        return {c: [pdf[c].iloc[0]] for c in g}

    def eliminate(pdf):
        block, x, y = _block_of(pdf, k, size)
        return pd.DataFrame(key_of(pdf) | {"_b": [int(pdf["_b"].iloc[0])]} | _flat(block.relation(x, y)))

    def pair_up(pdf):
        return pd.DataFrame(key_of(pdf) | {"_b": [int(pdf["_g"].iloc[0])]} | _flat(_up(*_stack(pdf.sort_values("_b"), k), k)[0]))

    def substitute(pdf, outer):
        pdf = pdf.sort_values("_b")
        nothing = np.zeros(k)
        left, right = (np.asarray(outer[c].iloc[0], float) for c in ("a", "z")) if len(outer) else (nothing, nothing)
        a, z = _down(_up(*_stack(pdf, k), k)[1], left, right, k)
        return pd.DataFrame({c: pdf[c].to_numpy() for c in g} | {"_b": pdf["_b"].to_numpy(), "a": a.tolist(), "z": z.tolist()})

    level = cut_lineage(dealt.where(F.col("_y").isNotNull()).groupBy(*g, "_b").applyInPandas(eliminate, relation))
    most = (level.agg(F.max("_b")).first()[0] or 0) + 1
    levels = [level]
    while most > group:                         # relations of relations
        level = cut_lineage(levels[-1].withColumn("_g", F.floor(F.col("_b") / group)).groupBy(*g, "_g").applyInPandas(pair_up, relation))
        levels.append(level)
        most = -(-most // group)
    found = None
    for level in reversed(levels):
        level = level.withColumn("_g", F.lit(0).cast("long") if found is None else F.floor(F.col("_b") / group))
        outer = level.select(*g, "_g").limit(0).selectExpr("*", "array(0D) a", "array(0D) z") if found is None \
            else found.withColumnRenamed("_b", "_g")
        found = level.groupBy(*g, "_g").cogroup(outer.groupBy(*g, "_g")).applyInPandas(substitute, edges)

    def fill(pdf, outer):
        gaps = pdf[pdf["_y"].isna()]
        if not len(gaps):
            return pd.DataFrame({c: pdf[c].iloc[:0] for c in (*g, idx)} | {"_fill": np.zeros(0)})
        block, x, y = _block_of(pdf, k, size)
        c = block.coefficients(x, y, *(np.asarray(outer[e].iloc[0], float) for e in ("a", "z")))
        start, value = block.basis(gaps["_x"].to_numpy(float))
        at = start[:, None] + np.arange(k + 1) - (block.r0 - k)
        return pd.DataFrame({name: gaps[name].to_numpy() for name in (*g, idx)} | {"_fill": (c[at] * value).sum(axis=1)})

    return dealt.groupBy(*g, "_b").cogroup(found.groupBy(*g, "_b")).applyInPandas(fill, filled)

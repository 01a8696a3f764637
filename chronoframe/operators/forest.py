"""Random forests of many rows over few features, from counts.

A tree sees a feature only through its bins (at most 32, as in ``pyspark.ml``), so
rows of one cell, the bins of all features together, meet in the same leaf.  Spark
counts the rows per cell and label; n such rows enter a tree's bootstrap with the sum
of n draws of Poisson(1), which is one draw of Poisson(n).  The sums per tree and cell
are all that a tree needs: they are bounded by the bins, whatever the number of rows,
and every tree grows in a group of its own."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import _whole, arrays, map_groups, matrix

BINS, DEPTH = 32, 5                             # the defaults of pyspark.ml
SUMS = 1 << 21                                  # cells times classes times trees that are still counted
BUCKETS, ROWS = 1024, 1 << 14                   # streams of random numbers, rows of one call
QUANTILES = 2000


def bin_cuts(values: Sequence[float], bins: int = BINS) -> list[float]:
    """Thresholds between the bins of a feature, from its quantiles: all midpoints of
    few distinct values, else those nearest to equal shares."""
    distinct, counts = np.unique(np.asarray(values, float), return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) < bins:
        return middle.tolist()
    share, upto, cuts = counts.sum() / bins, np.cumsum(counts), []
    target = share
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(float(middle[i - 1]))
            target += share
    return cuts[:bins - 1]


def bin_of(x: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """Number of the bin of ``x``; a missing value is in the last one."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(x <= F.lit(cuts[m]), bin_of(x, cuts[:m], first)).otherwise(bin_of(x, cuts[m + 1:], first + m + 1))


def _impurity(s: np.ndarray, classes: int) -> np.ndarray:
    """Weight times impurity of the sums ``s`` (..., statistics), up to what a split
    leaves as it is: Gini for classes, the variance for (weight, sum) of a number."""
    w = s.sum(-1) if classes else s[..., 0]
    square = (s ** 2).sum(-1) if classes else s[..., 1] ** 2
    return np.where(w > 0, (w if classes else 0.0) - square / np.where(w > 0, w, 1.0), 0.0)


def grow(bins: np.ndarray, stats: np.ndarray, shape: Sequence[int], classes: int, n_try: int,
         rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree over cells (``bins`` per feature, sums ``stats``): per node, numbered as
    in a heap from 1, its feature (-1: leaf), last bin to the left, and statistics."""
    size = 1 << (DEPTH + 1)
    feature, cut, sums = np.full(size, -1), np.zeros(size, int), np.zeros((size, stats.shape[1]))
    node = np.ones(len(bins), int)
    for at in range(1, size):
        mine = np.flatnonzero(node == at)
        sums[at] = stats[mine].sum(0)
        if not len(mine) or at >= size // 2:
            continue
        best = 0.0
        for f in sorted(rng.choice(len(shape), n_try, replace=False)):
            hist = np.stack([np.bincount(bins[mine, f], s, shape[f]) for s in stats[mine].T], 1)
            left = np.cumsum(hist, 0)[:-1]
            right = sums[at] - left
            gain = _impurity(sums[at], classes) - _impurity(left, classes) - _impurity(right, classes)
            weight = [x.sum(-1) if classes else x[..., 0] for x in (left, right)]
            gain = np.where((weight[0] > 0) & (weight[1] > 0), gain, 0.0)
            if len(gain) and gain.max() > best:
                best, feature[at], cut[at] = gain.max(), f, gain.argmax()
        if feature[at] >= 0:
            node[mine] = 2 * at + (bins[mine, feature[at]] > cut[at])
    if classes:                                 # leaves that name the same class are one leaf
        for at in range(size // 2 - 1, 0, -1):
            leaves = feature[at] >= 0 and all(x >= size // 2 or feature[x] < 0 for x in (2 * at, 2 * at + 1))
            if leaves and sums[2 * at].argmax() == sums[2 * at + 1].argmax():
                feature[at] = -1
    return feature, cut, sums


def leaf_sums(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Statistics of the leaf of every row of ``bins``."""
    node = np.ones(len(bins), int)
    for _ in range(DEPTH):
        f = feature[node]
        down = 2 * node + (bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[node])
        node = np.where(f < 0, node, down)
    return sums[node]


class CountedForest:
    """Estimator like ``pyspark.ml``'s: ``fit`` returns a model whose ``transform`` adds
    ``prediction``.  ``classes`` is 0 for a numeric label.  Where the features have too
    many cells to count (``SUMS``), ``otherwise`` is fitted instead."""

    def __init__(self, label: str, features: Sequence[str], classes: int, trees: int, seed: int, otherwise):
        self.label, self.features, self.classes = label, list(features), classes
        self.trees, self.seed, self.otherwise = trees, seed, otherwise

    def fit(self, train: DataFrame):
        classes, trees, seed, m = self.classes, self.trees, self.seed, len(self.features)
        found = train.approxQuantile(self.features, np.linspace(0, 1, QUANTILES + 1).tolist(), 0.5 / QUANTILES)
        cuts = [bin_cuts(v) for v in found]
        shape = [len(c) + 1 for c in cuts]
        n_slots = math.prod(shape) * max(classes, 1)
        if n_slots * trees > SUMS:
            return self.otherwise.fit(train)
        model = CountedModel(self.features, cuts)
        count = train.groupBy(model.cell().alias("_cell"), F.col(self.label).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
        count = count.withColumn("_bucket", F.pmod(F.xxhash64("_cell", "_y"), F.lit(BUCKETS)))

        def draw(batches):
            """Weight (and weighted label) per tree and slot, a cell or one of its classes."""
            total = np.zeros((n_slots, trees, 1 if classes else 2))
            for table, starts in _whole(batches, ["_bucket"]):
                cell, y, n, bucket = (table.column(c).to_numpy() for c in ("_cell", "_y", "_n", "_bucket"))
                slot = cell * classes + y.astype(int) if classes else cell
                for a, b in zip(starts, [*starts[1:], len(cell)]):
                    rng = np.random.default_rng([seed, int(bucket[a])])
                    for i in range(a, b, ROWS):
                        part = slice(i, min(i + ROWS, b))
                        w = rng.poisson(n[part, None], (len(n[part]), trees)).astype(float)
                        order = np.argsort(slot[part], kind="stable")
                        to, first = np.unique(slot[part][order], return_index=True)
                        total[to, :, 0] += np.add.reduceat(w[order], first)
                        if not classes:
                            total[to, :, 1] += np.add.reduceat((w * y[part, None])[order], first)
            at, tree = np.nonzero(total[:, :, 0])
            out = pa.table({"_tree": tree, "_slot": at, "_w": total[at, tree, 0], "_wy": total[at, tree, -1]})
            yield from out.to_batches()

        drawn = count.repartition("_bucket").sortWithinPartitions("_bucket", "_cell", "_y").mapInArrow(
            draw, "_tree long, _slot long, _w double, _wy double")
        cells = drawn.groupBy("_tree", "_slot").agg(F.sum("_w").alias("_w"), F.sum("_wy").alias("_wy"))
        # the shares of features per node are those of pyspark.ml
        n_try = m if trees == 1 else math.ceil(math.sqrt(m)) if classes else max(1, math.ceil(m / 3))

        def plant(table, starts):
            tree, slot, w, wy = (table.column(c).to_numpy() for c in ("_tree", "_slot", "_w", "_wy"))
            grown = []
            for a, b in zip(starts, [*starts[1:], len(slot)]):
                if classes:
                    cell, at = np.unique(slot[a:b] // classes, return_inverse=True)
                    stats = np.zeros((len(cell), classes))
                    stats[at, slot[a:b] % classes] = w[a:b]
                else:
                    cell, stats = slot[a:b], np.stack([w[a:b], wy[a:b]], 1)
                rng = np.random.default_rng([seed, int(tree[a]), BUCKETS])
                grown.append(grow(np.stack(np.unravel_index(cell, shape), 1), stats, shape, classes, n_try, rng))
            feature, cut, sums = (np.stack([g[i] for g in grown]) for i in range(3))
            return {"_tree": tree[starts], "_feature": arrays(feature), "_cut": arrays(cut),
                    "_sums": arrays(sums.reshape(len(sums), -1))}

        grown = map_groups(cells, ["_tree"], ["_slot"], plant,
                           "_tree long, _feature array<double>, _cut array<double>, _sums array<double>").toArrow()
        grid = np.stack(np.unravel_index(np.arange(math.prod(shape)), shape), 1)
        score = np.zeros((len(grid), max(classes, 1)))
        nodes = [matrix(grown.column(c)) for c in ("_feature", "_cut", "_sums")]
        for i in np.argsort(grown.column("_tree").to_numpy()):
            feature, cut, sums = (x[i] for x in nodes)
            s = leaf_sums(grid, feature.astype(int), cut, sums.reshape(len(feature), -1))
            w = s.sum(1) if classes else s[:, 0]
            score += (s if classes else s[:, 1:]) / np.where(w > 0, w, 1.0)[:, None]
        model.prediction = score.argmax(1).astype(float) if classes else score[:, 0] / trees
        return model


class CountedModel:
    """The forest's answer for every cell: a table bounded by ``SUMS``."""

    def __init__(self, features: list[str], cuts: list[list[float]]):
        self.features, self.cuts, self.prediction = features, cuts, np.zeros(0)

    def cell(self) -> Column:
        at = F.lit(0)
        for c, cuts in zip(self.features, self.cuts):
            at = at * F.lit(len(cuts) + 1) + bin_of(F.col(c), cuts)
        return at.cast("long")

    def transform(self, df: DataFrame) -> DataFrame:
        table = pd.DataFrame({"_cell": np.arange(len(self.prediction)), "prediction": self.prediction})
        answers = F.broadcast(df.sparkSession.createDataFrame(table, "_cell long, prediction double"))
        return df.withColumn("_cell", self.cell()).join(answers, "_cell", "left").drop("_cell")

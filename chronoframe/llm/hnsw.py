"""Approximate nearest neighbours: a hierarchical navigable small-world graph
per shard, stored as flat neighbour arrays, with the shards' results merged.

Rows are dealt to shards by a hash of the vector, so equal vectors meet in one
shard, where one node stands for them (with its smallest identifiers: of equal
vectors, only those can be among the nearest).  A shard's graph is one row of
flat arrays.  Query blocks visit every shard of their dimension, and the
distances that are returned are computed on the original vectors.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, stored
from .words import U64, mix, pack, unpack

SHARD_ROWS = 8192
QUERY_BLOCK = 32_768                             # queries that one task takes to a shard
LARGE = 1e150                                   # beyond, squares of components are not safe
LINKS = 16                                      # per node and level; twice as many at the bottom
EF_BUILD = 64
EF_SEARCH = 128


class Graph:
    """Levels of neighbour lists over the rows of ``x`` (float64).  Distances
    are squared differences in float64, of rows scaled by a power of two where
    their squares would overflow."""

    def __init__(self, x: np.ndarray, adjacent: list[np.ndarray], entry: int):
        self.adjacent, self.entry = adjacent, entry
        most = float(np.abs(x).max(initial=0.0))
        self.unit = 2.0 ** -math.frexp(most)[1] if most > LARGE else 1.0
        self.x = x if self.unit == 1.0 else x * self.unit

    def scaled(self, q: np.ndarray) -> np.ndarray:
        """A query in the unit of the rows, no farther than their squares allow."""
        return np.clip(q * self.unit, -LARGE, LARGE) if self.unit != 1.0 or np.abs(q).max() > LARGE else q

    def _near(self, q, rows):
        d = self.x[rows] - q
        return np.einsum("ij,ij->i", d, d)

    def _climb(self, q, node, dist, level):
        """Greedy walk on one level; every step is strictly nearer."""
        adj = self.adjacent[level]
        while True:
            nb = adj[node]
            nb = nb[nb >= 0]
            if not len(nb):
                return node, dist
            d = self._near(q, nb)
            k = int(d.argmin())
            if not d[k] < dist:
                return node, dist
            node, dist = int(nb[k]), float(d[k])

    def _beam(self, q, node, dist, level, ef, seen):
        """The ``ef`` nearest nodes met by a best-first search, nearest first."""
        adj = self.adjacent[level]
        stamp = seen[-1] = seen[-1] + 1
        seen[node] = stamp
        todo, best = [(dist, node)], [(-dist, node)]
        while todo:
            d, c = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            nb = adj[c]
            nb = nb[nb >= 0]
            nb = nb[seen[nb] != stamp]
            if not len(nb):
                continue
            seen[nb] = stamp
            near = self._near(q, nb)
            if len(best) >= ef:
                use = near < -best[0][0]
                nb, near = nb[use], near[use]
            for e, v in zip(near.tolist(), nb.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (-e, v))
                    heapq.heappush(todo, (e, v))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, v))
                    heapq.heappush(todo, (e, v))
        return sorted((-d, v) for d, v in best)

    def search(self, q: np.ndarray, ef: int, seen: np.ndarray) -> np.ndarray:
        """Rows of about the ``ef`` nearest vectors."""
        q = self.scaled(q)
        node = self.entry
        dist = float(self._near(q, np.array([node]))[0])
        for level in range(len(self.adjacent) - 1, 0, -1):
            node, dist = self._climb(q, node, dist, level)
        return np.array([v for _, v in self._beam(q, node, dist, 0, ef, seen)])


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; rows whose squares overflow are
    scaled by a power of two first."""
    with np.errstate(over="ignore"):
        d = x - q
        out = np.sqrt((d * d).sum(axis=1))
        far = np.flatnonzero(~np.isfinite(out))
        for i in far:                           # halves, so that the difference itself stays finite
            half = x[i] / 2 - q / 2
            unit = 2.0 ** (math.frexp(float(np.abs(half).max()))[1] - 1)
            out[i] = 2 * unit * math.sqrt(((half / unit) ** 2).sum())
    return out


def _spread(g: Graph, found: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
    """Up to ``most`` of the nearest nodes such that none is nearer to a chosen
    one than to the new node; the nearest others fill up what is left."""
    if len(found) <= most:
        return found
    v = g.x[[r for _, r in found]]
    chosen, rest = [], []
    nearest = np.full(len(found), np.inf)       # distance to the chosen ones
    for i, (d, _) in enumerate(found):
        if d < nearest[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            away = v - v[i]
            np.minimum(nearest, np.einsum("ij,ij->i", away, away), out=nearest)
        else:
            rest.append(i)
    chosen += rest[:most - len(chosen)]
    return [found[i] for i in chosen]


def build_graph(x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
    """Insert the rows of ``x`` one after another; a row's top level is drawn
    from a hash of its place."""
    n = len(x)
    u = (mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) / 2.0 ** 53
    top = np.floor(-np.log(1 - u) / math.log(links)).astype(int)
    height = int(top.max()) + 1
    width = [2 * links] + [links] * (height - 1)
    adjacent = [np.full((n, w), -1, np.int32) for w in width]
    gap = [np.full((n, w), np.inf) for w in width]          # squared distances beside the links
    g = Graph(x, adjacent, 0)
    seen = np.zeros(n + 1, np.int64)
    for i in range(1, n):
        q = g.x[i]
        node = g.entry
        dist = float(g._near(q, np.array([node]))[0])
        for level in range(int(top[g.entry]), int(top[i]), -1):
            node, dist = g._climb(q, node, dist, level)
        for level in range(min(int(top[i]), int(top[g.entry])), -1, -1):
            found = g._beam(q, node, dist, level, ef, seen)
            dist, node = found[0]
            own, adj, far = _spread(g, found, links), adjacent[level], gap[level]
            for k, (d, v) in enumerate(own):
                adj[i, k], far[i, k] = v, d
                free = int((adj[v] >= 0).sum())
                if free < width[level]:
                    adj[v, free], far[v, free] = i, d
                else:                           # a full list is chosen anew
                    now = sorted([*zip(far[v].tolist(), adj[v].tolist()), (d, i)])
                    kept = _spread(g, now, links + links // 2 if level == 0 else links - links // 4)
                    adj[v], far[v] = -1, np.inf
                    adj[v, :len(kept)] = [b for _, b in kept]
                    far[v, :len(kept)] = [a for a, _ in kept]
        if top[i] > top[g.entry]:
            g.entry = i
    return g


def _vectors(batches, k: int):
    """(dim, vector bytes, smallest identifiers) of a batch's distinct usable
    vectors, as (batch of dims, ...)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for rb in batches:
        if rb.num_rows == 0:
            continue
        col = rb.column("v").cast(pa.large_list(pa.float64()))
        size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(col.flatten(), np.nan).to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        ids = rb.column("id").to_numpy(zero_copy_only=False)
        groups: dict[bytes, list[int]] = {}
        known = pc.is_valid(rb.column("id")).to_numpy(zero_copy_only=False)
        for i in range(rb.num_rows):
            v = flat[start[i]:start[i] + size[i]]
            if size[i] and known[i] and np.isfinite(v).all() and v.any():
                groups.setdefault((v + 0.0).tobytes(), []).append(int(ids[i]))      # -0.0 equals 0.0
        yield groups, k


def _partial(k: int, shards: int):
    def run(batches):
        import pyarrow as pa
        import xxhash
        for groups, k_ in _vectors(batches, k):
            keys = list(groups)
            dim = [len(b) // 8 for b in keys]
            shard = [xxhash.xxh64_intdigest(b) % shards for b in keys]
            ids = [sorted(groups[b])[:k + 1] for b in keys]
            yield pa.record_batch({"dim": pa.array(dim, pa.int32()), "shard": pa.array(shard, pa.int32()),
                                   "vec": pa.array(keys, pa.binary()), "ids": pa.array(ids, pa.list_(pa.int64()))})
    return run


def _build(k: int, links: int, ef: int):
    def run(t):
        import pyarrow as pa
        groups: dict[bytes, list[int]] = {}
        for b, ids in zip(t.column("vec").to_pylist(), t.column("ids").to_pylist()):
            groups.setdefault(b, []).extend(ids)
        # in order of the identifiers, so that reruns build the same graph
        order = sorted((sorted(ids)[:k + 1], b) for b, ids in groups.items())
        x = np.frombuffer(b"".join(b for _, b in order), np.float64).reshape(len(order), -1)
        g = build_graph(x, links, ef)
        ids = np.concatenate([np.array(i, np.int64) for i, _ in order])
        return pa.table({
            "dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1),
            "vectors": pa.array([x.tobytes()], pa.binary()), "ids": pa.array([pack(ids)], pa.binary()),
            "n_ids": pa.array([pack(np.array([len(i) for i, _ in order], np.int32))], pa.binary()),
            "entry": pa.array([g.entry], pa.int64()),
            "links": pa.array([[pack(a.ravel()) for a in g.adjacent]], pa.list_(pa.binary()))})
    return run


_INDEX = "dim int, shard int, vectors binary, ids binary, n_ids binary, entry long, links array<binary>"


def build_index(vectors: DataFrame, id_col: str, vec_col: str, k: int = 10, shard_rows: int = SHARD_ROWS,
                links: int = LINKS, ef_build: int = EF_BUILD) -> DataFrame:
    """One stored row per shard and dimension: vectors, identifiers, and the
    graph's levels as flat neighbour arrays.  ``k`` bounds the neighbours that
    may be asked for: of equal vectors the ``k`` + 1 smallest identifiers stay."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    shards = buckets_for(src.count(), shard_rows)
    dealt = src.mapInArrow(_partial(k, shards), "dim int, shard int, vec binary, ids array<bigint>")
    # a task per shard: building is the dear part, and adaptive merging would queue shards
    dealt = dealt.repartition(shards, "dim", "shard")
    return stored(dealt.groupBy("dim", "shard").applyInArrow(_build(k, links, ef_build), _INDEX), "hnsw")


def _visit(k: int, ef: int):
    def run(left, right):
        import pyarrow as pa
        out_q, out_v, out_d = [], [], []
        for row in left.to_pylist():
            x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            n_ids = unpack(row["n_ids"], np.int32)
            ids, start = unpack(row["ids"], np.int64), np.cumsum(n_ids) - n_ids
            g = Graph(x, [unpack(b, np.int32).reshape(len(x), -1) for b in row["links"]], row["entry"])
            seen = np.zeros(len(x) + 1, np.int64)
            for q_id, b in zip(right.column("query_id").to_pylist(), right.column("vec").to_pylist()):
                q = np.frombuffer(b, np.float64)
                rows = g.search(q, max(ef, k + 1), seen)
                d = distances(x[rows], q)
                near = sorted((float(e), int(v)) for e, r in zip(d, rows) for v in ids[start[r]:start[r] + n_ids[r]] if v != q_id)
                for e, v in near[:k]:
                    out_q.append(q_id)
                    out_v.append(v)
                    out_d.append(e)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                         "score": pa.array(out_d, pa.float64())})
    return run


def _usable():
    def run(batches):
        import pyarrow as pa
        for groups, _ in _vectors(batches, 0):
            rows = [(i, b) for b, ids in groups.items() for i in ids]
            yield pa.record_batch({"query_id": pa.array([i for i, _ in rows], pa.int64()),
                                   "dim": pa.array([len(b) // 8 for _, b in rows], pa.int32()),
                                   "vec": pa.array([b for _, b in rows], pa.binary())})
    return run


def nearest(queries: DataFrame, index: DataFrame, id_col: str, vec_col: str, k: int = 10, ef: int = EF_SEARCH,
            block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest rows found for every query but the query's own
    identifier: query_id, rank (from 1), vec_id, score (Euclidean distance in
    double precision), nearest first, ties to the smaller identifier.

    Vectors that are NULL, empty, all zero, or hold NULL or non-finite
    components take no part, nor do rows with a NULL identifier; vectors of
    another dimension are no candidates.  Fewer candidates than ``k`` give
    fewer rows; an empty table gives an empty result."""
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(
        _usable(), "query_id long, dim int, vec binary").distinct()
    blocks = buckets_for(queries.count(), block)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    # every block visits every shard of its dimension; one small row per shard
    shards = index.select(F.col("dim").alias("to_dim"), F.col("shard").alias("to_shard"))
    visits = asked.join(F.broadcast(shards), F.col("dim") == F.col("to_dim")).select(
        "to_dim", "to_shard", F.col("block").alias("to_block"), "query_id", "vec")
    found = index.select("*", every).groupBy("dim", "shard", "block").cogroup(
        visits.groupBy("to_dim", "to_shard", "to_block")).applyInArrow(_visit(k, ef), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

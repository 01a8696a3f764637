"""Exact integer k-means with ns-bounds.

Vectors become integers and are packed into blocks, which are stored once in
buckets of their block number.  A vector's state is its cluster, an upper bound
(the distance to its centroid) and a lower bound (the distance to the nearest
other centroid), each with the round in which it was last evaluated.  The
centroids of all rounds are retained (rounds x centroids, the model's size), so
a bound is loosened by the norm of a centroid's total displacement since that
round, not by the sum of its moves.  While the loosened upper bound stays below
the loosened lower bound, the assignment cannot have changed; else the own
distance is evaluated anew, and if that is not enough the vector is scanned
against all centroids.  Bounds are doubles and are compared with a margin;
every decision between centroids is made on whole numbers, ties to the smaller
centroid.

A round joins the blocks with their states, both bucketed by block, so no vector
is shuffled, writes the new states, and adds up every cluster's members as
32-bit limbs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, shuffle_partitions

BLOCK_ROWS = 4096
BUCKET_BLOCKS = 256                             # blocks in a bucket, at most about
LIMBS = 8                                       # of 32 bits, the last one signed: sums below 2^280
LARGEST = 2.0 ** 200                            # components beyond take no part
MARGIN = 1e-9                                   # relative, of the bounds' doubles


# -- whole numbers ---------------------------------------------------------

def packed(x: np.ndarray) -> tuple[bytes, str]:
    """Whole numbers, given as doubles, in the smallest type that holds them all."""
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<f8"
    return x.astype(kind).tobytes(), kind


def unpacked(data: bytes, kind: str, dim: int) -> np.ndarray:
    """Rows as doubles if every distance between such rows is exact in doubles,
    else as Python integers."""
    x = np.frombuffer(data, kind).reshape(-1, dim)
    if kind != "<f8":
        return x.astype(np.float64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(-1, dim)


def exact_in_doubles(*arrays: np.ndarray) -> bool:
    most = max(float(np.abs(a).max(initial=0)) for a in arrays)
    return 4 * arrays[0].shape[1] * most * most < 2.0 ** 53


def to_integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64).astype(object)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances, exactly: whole doubles or Python integers."""
    if x.dtype != object and exact_in_doubles(x, c):
        c = c.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    x, c = to_integers(x), to_integers(c)
    return (x * x).sum(axis=1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(axis=1)[None, :]


def own_distances(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Squared distance of every row to its own centroid, exactly."""
    if x.dtype != object and exact_in_doubles(x, c):
        return ((x - c.astype(np.float64)[cluster]) ** 2).sum(axis=1)
    return ((to_integers(x) - to_integers(c)[cluster]) ** 2).sum(axis=1)


def root(d: np.ndarray) -> np.ndarray:
    return np.array([math.sqrt(v) for v in d.tolist()]) if d.dtype == object else np.sqrt(d)


def limbs(value: int) -> list[int]:
    """32-bit limbs of an integer, lowest first; the last one is signed."""
    return [(value >> 32 * k) & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


def whole(parts) -> int:
    return sum(int(v) << 32 * k for k, v in enumerate(parts))


# -- one block in one round ------------------------------------------------

class State:
    """Cluster, bounds and the rounds of their last evaluation, of a block's rows."""

    def __init__(self, n: int):
        self.cluster = np.full(n, -1, np.int32)
        self.upper, self.lower = np.full(n, np.inf), np.full(n, -np.inf)
        self.upper_at, self.lower_at = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.scanned = 0

    FIELDS = (("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8"), ("upper_at", "<i4"), ("lower_at", "<i4"))

    def dump(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS}

    @classmethod
    def load(cls, row: dict) -> State:
        out = cls(0)
        for name, kind in cls.FIELDS:
            setattr(out, name, np.frombuffer(row[name], kind).copy())
        return out


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """Norm of every centroid's move from each round to the last one."""
    now = to_integers(history[-1])
    out = np.zeros((len(history), len(now)))
    for t, then in enumerate(history[:-1]):
        out[t] = root(((now - to_integers(then)) ** 2).sum(axis=1))
    return out


def reassign(x: np.ndarray, state: State, history: list[np.ndarray], moved: np.ndarray) -> None:
    """Assign the rows to the last centroids of ``history``; ``moved`` are its
    displacements."""
    c, now = history[-1], len(history) - 1
    k = len(c)
    first = state.cluster < 0
    own = np.where(first, 0, state.cluster)
    # the largest displacement of any other centroid, by round and own centroid
    others = np.tile(moved.max(axis=1)[:, None], (1, k))
    top = moved.argmax(axis=1)
    rest = moved.copy()
    rest[np.arange(len(moved)), top] = -np.inf
    others[np.arange(len(moved)), top] = rest.max(axis=1)
    away = others[state.lower_at, own]
    lower = state.lower - np.where(np.isfinite(away), away, 0.0)        # a single centroid has no rival

    def unsettled(upper):
        return first | ~(upper + MARGIN * (upper + np.abs(lower)) < lower)

    upper = state.upper + moved[state.upper_at, own]
    doubtful = np.flatnonzero(unsettled(upper))
    known = doubtful[~first[doubtful]]
    if len(known):
        upper[known] = root(own_distances(x[known], c, own[known]))
        state.upper[known], state.upper_at[known] = upper[known], now
    scan = doubtful[unsettled(upper)[doubtful]]
    state.scanned = len(scan)
    if not len(scan):
        return
    d = squared_distances(x[scan], c)
    at, rows = d.argmin(axis=1), np.arange(len(scan))       # the smaller number on ties
    nearest = d[rows, at]
    d[rows, at] = math.inf
    state.cluster[scan] = at
    state.upper[scan], state.upper_at[scan] = root(nearest), now
    state.lower[scan] = root(d.min(axis=1)) if k > 1 else np.inf
    state.lower_at[scan] = now


def member_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and componentwise sums of every cluster, in integers."""
    sums = np.zeros((k, x.shape[1]), object if x.dtype == object else np.int64)
    for j in np.unique(cluster):
        sums[j] = (x[cluster == j] if x.dtype == object else x[cluster == j].astype(np.int64)).sum(axis=0)
    return np.bincount(cluster, minlength=k), sums


# -- the job ---------------------------------------------------------------

def _pack(dim: int, scale: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for rb in batches:
            for lo in range(0, rb.num_rows, BLOCK_ROWS):
                part = rb.slice(lo, BLOCK_ROWS)
                flat = part.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                data, kind = packed(np.floor(scale * flat))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("_id"))
                yield pa.record_batch({"block": pa.array([block], pa.int64()), "ids": ids,
                                       "kind": pa.array([kind]), "x": pa.array([data], pa.binary())})
                block += 1
    return run


_STATE = "block long, scanned long, " + ", ".join(f"{name} binary" for name, _ in State.FIELDS)


def _round(dim: int, history: list[np.ndarray], last: bool):
    k = len(history[0])
    moved = displacements(history)

    def run(batches):
        import pyarrow as pa
        for rb in batches:
            for row in rb.to_pylist():
                x = unpacked(row["x"], row["kind"], dim)
                state = State(len(x)) if row.get("cluster") is None else State.load(row)
                reassign(x, state, history, moved)
                out = {"block": pa.array([row["block"]], pa.int64()), "scanned": pa.array([state.scanned], pa.int64())}
                if last:
                    d = [int(v) for v in own_distances(x, history[-1], state.cluster).tolist()]
                    inertia = [0] * k
                    for j, v in zip(state.cluster.tolist(), d):
                        inertia[j] += v
                    out |= {"cluster": pa.array([state.cluster.tolist()], pa.list_(pa.int32())),
                            "distance": pa.array([[v if v < 2 ** 63 else None for v in d]], pa.list_(pa.int64())),
                            "sums": pa.array([[p for v in inertia for p in limbs(v)]], pa.list_(pa.int64()))}
                else:
                    counts, sums = member_sums(x, state.cluster, k)
                    out |= {name: pa.array([data], pa.binary()) for name, data in state.dump().items()}
                    out |= {"members": pa.array([counts.tolist()], pa.list_(pa.int64())),
                            "sums": pa.array([[p for v in sums.ravel().tolist() for p in limbs(int(v))]], pa.list_(pa.int64()))}
                yield pa.record_batch(out)
    return run


def _added(columns: list[str]):
    """Sums over a task's blocks of arrays of whole numbers (limbs)."""
    def run(batches):
        import pyarrow as pa
        total: dict[str, np.ndarray] = {}
        for rb in batches:
            for name in columns:
                for row in rb.column(name).to_pylist():
                    part = np.array(row, np.int64)
                    total[name] = total[name] + part if name in total else part
        for name, values in total.items():
            yield pa.record_batch({"name": pa.array([name] * len(values)), "place": pa.array(range(len(values)), pa.int32()),
                                   "total": pa.array(values)})
    return run


def _totals(table: DataFrame, columns: list[str]) -> dict[str, list[int]]:
    """Whole sums per column; the driver gets limbs of model size."""
    parts = table.select(*columns).mapInArrow(_added(columns), "name string, place int, total long")
    out: dict[str, list[int]] = {}
    for r in parts.groupBy("name", "place").agg(F.sum("total").alias("total")).orderBy("name", "place").collect():
        out.setdefault(r["name"], []).append(r.total)
    return {name: v if name == "members" else [whole(v[i:i + LIMBS]) for i in range(0, len(v), LIMBS)]
            for name, v in out.items()}


def _members(kind: str, sizes: list, inertia, hashes: list[str]):
    def run(batches):
        import pyarrow as pa
        for rb in batches:
            for row in range(rb.num_rows):
                cluster = rb.column("cluster")[row].values
                of = cluster.to_numpy()
                yield pa.record_batch({
                    "_id": rb.column("ids")[row].values, "cluster": cluster, "distance": rb.column("distance")[row].values,
                    "cluster_inertia": pa.array([sizes[j] for j in of], pa.int64()),
                    "inertia": pa.array([inertia] * len(of), pa.int64()),
                    "centroid_sha256": pa.array([hashes[j] for j in of], pa.string())})
    return run


def usable(vec: str, dim: int):
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(LARGEST)))
    return F.col(vec).isNotNull() & (F.size(vec) == dim) & finite


def seeds(src: DataFrame, k: int, prefix: str, scale: int) -> list[list[int]]:
    """The ``k`` rows with the smallest hash of prefix and identifier."""
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    rows = src.withColumn("_key", key).orderBy("_key", "v").limit(k).collect()
    return [[math.floor(scale * float(c)) for c in r.v] for r in rows]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, prefix: str = "2:",
            id_col: str = "vec_id", vec_col: str = "embedding", scans: list[int] | None = None) -> DataFrame:
    """k-means over floor(scale * component), from the ``k`` usable vectors with
    the smallest sha256 of ``prefix`` and identifier: ``rounds`` times assign all
    and replace every centroid with members by floor(sum / count), then assign
    once more.

    One row per usable vector: ``id_col``, cluster, distance (squared),
    cluster_inertia, inertia (sums of distance), centroid_sha256 (of the final
    centroid's decimal components joined by commas).  A sum or distance beyond
    2^63 - 1 is NULL.  ``scans`` collects how many vectors each assignment
    scanned against all centroids.

    Vectors that are NULL, of another length, or hold NULL, non-finite or
    (absolute) components from 2^200 on take no part; a float column can't hold
    the latter.  Fewer vectors than ``k`` give as many centroids.  Identifiers
    may be NULL (their seed hash is that of the prefix alone) or repeated: every
    row takes part.  Other columns are not read; an empty table gives an empty
    result."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("v")).where(usable("v", dim))
    id_type = src.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    start = seeds(src, k, prefix, scale)
    if not start:
        return spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    rows = src.count()
    parts = shuffle_partitions(spark)
    blocks = -(-rows // BLOCK_ROWS)
    tables = Bucketed(spark, "block", max(1, min(rows, max(min(parts, 2 * blocks), blocks // BUCKET_BLOCKS))))
    packed_rows = src.mapInArrow(_pack(dim, scale), f"block long, ids array<{id_type}>, kind string, x binary")
    base = tables.write(packed_rows.repartition(tables.buckets, "block"), "blocks")
    history, state, old = [np.array(start, object)], None, None
    wide = _STATE + ", members array<long>, sums array<long>"
    for t in range(rounds + 1):
        last = t == rounds
        given = tables.read(base).select("block", "kind", "x")
        if state is not None:
            given = given.join(tables.read(state).select("block", *[name for name, _ in State.FIELDS]), "block")
        made = given.mapInArrow(_round(dim, history, last), wide if not last else
                                "block long, scanned long, cluster array<int>, distance array<long>, sums array<long>")
        old, state = state, tables.write(made, f"round{t}")
        if old is not None:
            tables.drop(old)
        now = tables.read(state)
        if scans is not None:
            scans.append(now.agg(F.sum("scanned")).first()[0])
        total = _totals(now, ["sums"] if last else ["members", "sums"])
        if not last:
            c = history[-1].copy()
            for j, n in enumerate(total["members"]):
                if n:
                    c[j] = [s // n for s in total["sums"][j * dim:(j + 1) * dim]]
            history.append(c)
    fits = [v if v < 2 ** 63 else None for v in [*total["sums"], sum(total["sums"])]]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    final = tables.read(base).select("block", "ids").join(tables.read(state).select("block", "cluster", "distance"), "block")
    out = final.mapInArrow(_members(id_type, fits[:-1], fits[-1], hashes), schema)
    return out.withColumnRenamed("_id", id_col)

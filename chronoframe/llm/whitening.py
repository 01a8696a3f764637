"""Whitening of integer-scaled embeddings with an exact, bit-sliced scatter.

Every component becomes an integer.  Shifted by its dimension's minimum, a
dimension is a few bit planes; the planes of a block of rows are packed into
64-bit words, 64 rows a word.  The sum over the block of y_i y_j is then the sum
over pairs of planes of 2^(a+b) times the population count of the AND of their
words: whole numbers throughout, in any order, with any number of rows.  Blocks
are added up as 32-bit limbs, so that no sum overflows, and the scatter matrix
is centred as integers (n * sum of products - product of sums) before a double
is made of it and its eigenvectors are taken.

What reaches the driver is one number per pair of dimensions, never a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
OFFSET = 1_000_000
BLOCK_ROWS = 8192                               # rows whose planes are packed together
LIMBS = 6                                       # of 32 bits: sums below 2^191
#: components with a smaller share of the largest eigenvalue have no direction of their own
LEAST_SHARE = 1e-11


def usable(vec: str):
    """Whether a vector is not NULL, not empty and holds finite components only,
    small enough that the integer is a long."""
    fits = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(2.0 ** 53)))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & fits


def integers(column, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """Rows of floor(scale * c) + offset from an Arrow list column of equally long vectors."""
    import pyarrow as pa
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if not len(col):
        return np.zeros((0, 0), np.int64)
    return np.floor(scale * flat).astype(np.int64).reshape(len(col), -1) + offset


def bit_planes(y: np.ndarray, width: int) -> np.ndarray:
    """Planes of the non-negative ``y`` (rows x dimensions) as packed words:
    dimensions x ``width`` x words."""
    n, d = y.shape
    words = -(-n // 64)
    bits = np.zeros((d, width, words * 64), np.uint8)
    for b in range(width):
        bits[:, b, :n] = ((y >> b) & 1).T
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def sliced_products(planes: np.ndarray) -> list[list[int]]:
    """Sum over rows of y_i y_j for i <= j, and of y_i in a last list."""
    d, width, _ = planes.shape
    flat = planes.reshape(d * width, -1)
    weight = np.arange(width)[:, None] + np.arange(width)[None, :]
    out = []
    for i in range(d):
        # AND-popcounts of this dimension's planes with those of every later one
        counts = np.stack([np.bitwise_count(flat[i * width:] & planes[i, a]).sum(axis=1, dtype=np.int64)
                           for a in range(width)], axis=1)
        counts = counts.reshape(d - i, width, width)
        total = [0] * (d - i)
        for s in range(2 * width - 1):
            for j, c in enumerate(counts[:, weight == s].sum(axis=1).tolist()):
                total[j] += c << s
        out.append(total)
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).tolist()
    out.append([sum(c << b for b, c in enumerate(row)) for row in ones])
    return out


def limbs(value: int) -> list[int]:
    """A non-negative integer as 32-bit limbs, lowest first."""
    return [(value >> 32 * k) & 0xFFFFFFFF for k in range(LIMBS)]


def whole(parts) -> int:
    return sum(int(v) << 32 * k for k, v in enumerate(parts))


def _ranges(scale: int, offset: int):
    """Smallest and largest integer of every dimension, and the rows, per task."""
    def run(batches):
        import pyarrow as pa
        low, high, n = None, None, 0
        for rb in batches:
            x = integers(rb.column("v"), scale, offset)
            if len(x):
                a, b = x.min(axis=0), x.max(axis=0)
                low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
                n += len(x)
        if low is not None:
            yield pa.record_batch({"dim": pa.array(range(len(low)), pa.int32()), "low": pa.array(low), "high": pa.array(high),
                                   "n": pa.array(np.full(len(low), n))})
    return run


def _scatter(low: np.ndarray, width: int, scale: int, offset: int):
    d = len(low)

    def run(batches):
        import pyarrow as pa
        total = None
        for rb in batches:
            x = integers(rb.column("v"), scale, offset)
            for lo in range(0, len(x), BLOCK_ROWS):
                part = sliced_products(bit_planes(x[lo:lo + BLOCK_ROWS] - low, width))
                total = part if total is None else [[a + b for a, b in zip(r, s)] for r, s in zip(total, part)]
        if total is None:
            return
        i = [a for a in range(d) for _ in total[a]] + [d] * d
        j = [b for a in range(d) for b in range(a, d)] + list(range(d))
        parts = [limbs(v) for row in total for v in row]
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                               **{f"l{k}": pa.array([p[k] for p in parts], pa.int64()) for k in range(LIMBS)}})
    return run


class Whitening:
    """Shift, exact sums and components of a fit list of ``n`` vectors."""

    def __init__(self, n: int, low: list[int], sums: list[int], products: list[list[int]], most: int, scale: int, offset: int):
        self.n, self.low, self.sums, self.scale, self.offset = n, low, sums, scale, offset
        d = len(low)
        # centred as integers: n times the sum of products less the product of sums
        centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        cov = np.array([[c / (n * n) for c in row] for row in centred])         # one rounding each
        value, vector = np.linalg.eigh(cov)
        value, vector = value[::-1], vector[:, ::-1]
        trace = sum(centred[i][i] for i in range(d)) / (n * n)
        keep = [k for k in range(min(most, d)) if value[k] > LEAST_SHARE * value[0] and value[k] > 0]
        self.value, self.vector = value[keep], vector[:, keep]
        self.explained = self.value / trace if trace else self.value

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly, as an integer array (of Python integers if need be)."""
        y = x - np.array(self.low, np.int64)
        if int(y.max(initial=0)) * self.n < 2 ** 62:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) / self.n @ (self.vector / np.sqrt(self.value))

    def deviation(self, centred: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2 as Python integers."""
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * max(1, centred.shape[1]) < 2 ** 62:
            return (centred ** 2).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in centred.tolist()]


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 32, scale: int = SCALE,
        offset: int = OFFSET) -> Whitening | None:
    """Fit to every usable vector; None if there is none.  Vectors must have one
    length (see ``whiten``)."""
    src = vectors.select(F.col(vec_col).alias("v"))
    ranges = src.mapInArrow(_ranges(scale, offset), "dim int, low long, high long, n long")
    dims = ranges.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
                                     ).orderBy("dim").collect()                         # one row per dimension
    if not dims:
        return None
    low = [r.low for r in dims]
    width = max(1, max(r.high - r.low for r in dims).bit_length())
    d, n = len(low), dims[0].n
    parts = src.mapInArrow(_scatter(np.array(low, np.int64), width, scale, offset),
                           "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    summed = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()  # d^2 numbers
    products, sums = [[0] * d for _ in range(d)], [0] * d
    for r in summed:
        value = whole(r[2:])
        if r.i == d:
            sums[r.j] = value
        else:
            products[r.i][r.j] = products[r.j][r.i] = value
    return Whitening(n, low, sums, products, components, scale, offset)


def _products_of_whitened(model: Whitening):
    def run(batches):
        import pyarrow as pa
        total = None
        for rb in batches:
            x = integers(rb.column("v"), model.scale, model.offset)
            for lo in range(0, len(x), BLOCK_ROWS):
                w = model.whitened(model.centred(x[lo:lo + BLOCK_ROWS]))
                part = np.vstack([w.T @ w, w.sum(axis=0)])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.record_batch({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()),
                                   "total": pa.array(total.ravel())})
    return run


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance, measured on
    the whitened vectors themselves, minus the identity."""
    src = vectors.select(F.col(vec_col).alias("v"))
    parts = src.mapInArrow(_products_of_whitened(model), "i int, j int, total double")
    k = len(model.value)
    total = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():      # at most 33 x 32 numbers
        total[r.i, r.j] = r.total
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def _rows(model: Whitening, error: float):
    k = len(model.value)

    def run(batches):
        import pyarrow as pa
        for rb in batches:
            for lo in range(0, rb.num_rows, BLOCK_ROWS):
                part = rb.slice(lo, BLOCK_ROWS)
                centred = model.centred(integers(part.column("v"), model.scale, model.offset))
                w, m = model.whitened(centred), part.num_rows
                away = [v if v < 2 ** 63 else None for v in model.deviation(centred)]
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch({
                    "_id": part.column("_id").take(at), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, model.n), pa.int64()), "deviation": pa.array(away, pa.int64()).take(at),
                    "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(model.explained, m)),
                    "identity_error": pa.array(np.full(m * k, error))})
    return run


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row per usable vector and component: ``id_col``, component (from 1 by
    falling eigenvalue), n (vectors in the fit list), deviation (sum over
    dimensions of (n * x - S)^2), whitened, explained (share of the trace),
    identity_error.

    Vectors that are NULL or empty, or hold NULL, non-finite or (absolute)
    components from 2^53 on, take no part.  If vectors differ in length, those
    of the most frequent length take part (the longer on a tie).  A direction
    without variance (below 1e-11 of the largest) cannot be whitened and has no
    rows, so one vector, or equal vectors alone, give none.  A deviation beyond
    2^63 - 1 is NULL.  Identifiers may be NULL or repeated: every row takes part
    by itself.  Other columns are not read; an empty table gives an empty result."""
    src = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("v")).where(usable("v"))
    lengths = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    schema = (f"_id {src.schema['_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    same = src.where(F.size("v") == (lengths[0].d if lengths else 0))
    model = fit(same, "v", components, scale, offset)
    if model is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    else:
        out = same.mapInArrow(_rows(model, identity_error(same, model, "v")), schema)
    return out.withColumnRenamed("_id", id_col)

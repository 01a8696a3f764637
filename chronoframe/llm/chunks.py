"""Documents as a stored table of compressed chunks, and questions to hash buckets.

A chunk is one row that holds the texts of some megabytes of documents.  It is
the unit in which tasks hash words, and because it is stored under a number,
its tasks can send packed requests to buckets of the hash space (one row per
chunk and bucket, whatever the number of words) and get answers in the order
of the request, without ever shuffling a row per word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .words import pack, unpack

CHUNK_BYTES = 8 << 20
MAX_DOCS = 1 << 20                              # documents added to a chunk at a time
NO_ID = np.iinfo(np.int64).max                  # stands for a NULL identifier: after all others


def _chunked(limit: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard
        from pyspark import TaskContext

        from .words import buffer_of
        base = TaskContext.get().partitionId() << 33
        seq = 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        parts: list[bytes] = []
        held = 0

        def row():
            nonlocal seq, held
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            i = np.concatenate(ids)
            out = pa.record_batch({
                "chunk": pa.array([base + seq], pa.int64()), "n_docs": pa.array([len(i)], pa.int64()),
                "n_bytes": pa.array([held], pa.int64()), "ids": pa.array([pack(i)], pa.binary()),
                "sizes": pa.array([pack(np.concatenate(sizes))], pa.binary()),
                "flags": pa.array([pack(np.concatenate(flags))], pa.binary()), "texts": pa.array([blob], pa.binary())})
            seq, held = seq + 1, 0
            ids.clear(), sizes.clear(), flags.clear(), parts.clear()
            return out

        for rb in batches:
            if rb.num_rows == 0:
                continue
            data, off = buffer_of(rb.column("_t"))
            doc = pc.fill_null(rb.column("_id"), int(NO_ID)).to_numpy(zero_copy_only=False)
            flag = rb.column("_f").to_numpy(zero_copy_only=False).astype(np.uint8)
            lo = 0
            while lo < len(doc):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit - held, side="right")) - 1)
                hi = min(hi, len(doc), lo + MAX_DOCS)
                ids.append(doc[lo:hi].astype(np.int64))
                sizes.append(np.diff(off[lo:hi + 1]).astype(np.int64))
                flags.append(flag[lo:hi])
                parts.append(data[off[lo]:off[hi]].tobytes())
                held += int(off[hi] - off[lo])
                lo = hi
                if held >= limit or sum(map(len, ids)) >= MAX_DOCS or len(doc) - lo and held + (off[lo + 1] - off[lo]) > limit:
                    yield row()
        if ids:
            yield row()
    return run


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Stored rows (chunk, n_docs, n_bytes, ids, sizes, flags, texts).
    Identifiers are integers; NULL texts count as empty; ``flag`` is a boolean
    that goes with every document."""
    flag = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"), flag.alias("_f"))
    small_batches(docs.sparkSession)
    return stored(src.mapInArrow(_chunked(chunk_bytes), (
        "chunk long, n_docs long, n_bytes long, ids binary, sizes binary, flags binary, texts binary")), "chunks")


def read_chunk(ids: bytes, sizes: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document identifiers, bytes, document offsets) of a chunk."""
    import zstandard
    size = unpack(sizes, np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
    return unpack(ids, np.int64), data, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def bucket_edges(n_buckets: int) -> np.ndarray:
    """First hash of every bucket: equal ranges of the 64-bit hash space."""
    return np.array([(b << 64) // n_buckets for b in range(n_buckets)], np.uint64)


def split_sorted(hashes: np.ndarray, n_buckets: int):
    """(bucket, first, last) of the non-empty buckets of ascending hashes."""
    cuts = np.append(np.searchsorted(hashes, bucket_edges(n_buckets)), len(hashes))
    for b in range(n_buckets):
        if cuts[b + 1] > cuts[b]:
            yield b, int(cuts[b]), int(cuts[b + 1])


def per_chunk(chunks: DataFrame, replies: DataFrame | None, fn, schema: str) -> DataFrame:
    """``fn(chunk row as dict, replies as list of dicts)`` gives a pyarrow table
    per chunk.  With ``replies`` both are dealt by chunk number."""
    if replies is None:
        def alone(batches):
            for rb in batches:
                for i in range(rb.num_rows):
                    yield from fn(rb.slice(i, 1).to_pylist()[0], []).to_batches()
        return chunks.mapInArrow(alone, schema)

    nothing = empty_table(schema)               # the schema's text needs a session to be read

    def both(left, right):
        import pyarrow as pa
        rows = right.to_pylist()
        tables = [fn(r, rows) for r in left.to_pylist()]
        return pa.concat_tables(tables) if tables else nothing
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)


def empty_table(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()

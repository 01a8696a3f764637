"""Substring dedup by level-wise doubling.

A run of words can only repeat if its halves do.  Runs of a short length are
checked first, and only where they repeat in another document are they joined
to runs of up to twice the length, until the wanted window is reached or no
candidate survives.  At the shortest length a window is represented by the
smallest of its runs' hashes: it repeats only if that run does, and
neighbouring windows mostly share it, so that a quarter of the runs is sent.
At the window's own length, the smallest document identifier of every
surviving window decides which copies go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, chunk_table, per_chunk, read_chunk, split_sorted
from .common import buckets_for, shuffle_partitions, stored
from .words import U64, gram_hashes, pack, pack_sorted, run_hashes, unpack, unpack_sorted, word_hashes, word_spans

SEED = 8                                        # longest run that starts the doubling
BUCKET_BYTES = 64 << 20                         # text per hash bucket
_REQUEST = "bucket int, chunk long, hashes binary, extra binary"
_REPLY = "chunk long, level int, bucket int, n_live long, bits binary"


def levels(window: int, seed: int = SEED) -> list[int]:
    """Run lengths up to ``window``, each at most twice the one before."""
    out = [window]
    while out[0] > seed:
        out.insert(0, -(-out[0] // 2))
    return out


class ChunkWindows:
    """Word windows of one chunk, and the candidates that survive each level."""

    def __init__(self, row: dict, window: int, seed: int):
        self.ids, self.data, self.off = read_chunk(row["ids"], row["sizes"], row["texts"])
        self.start, self.end, self.first = word_spans(self.data, self.off)
        self.window, self.lengths = window, levels(window, seed)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        n = len(self.start) - window + 1
        if n <= 0:
            self.at = np.zeros(0, np.int64)
            self.run = np.zeros(0, np.uint64)
            return
        words = word_hashes(self.data, self.start, self.end)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1:])      # windows within one document
        self.run = gram_hashes(words, self.lengths[0])

    def key(self, level: int) -> np.ndarray:
        """What stands for every candidate window at this level."""
        if level == 0 and len(self.lengths) > 1:
            n = self.window - self.lengths[0] + 1
            least = self.run[self.at].copy()
            for k in range(1, n):
                np.minimum(least, self.run[self.at + k], out=least)
            return least
        if level == 0:
            return self.run[self.at]
        # joined from the runs of the level before; they may overlap by a word
        out = np.zeros(len(self.run), np.uint64)
        step = self.lengths[level] - self.lengths[level - 1]
        m = len(self.run) - step
        out[:m] = run_hashes(self.run[:m], self.run[step:])
        self.run = out[:m]
        return self.run[self.at]

    def narrow(self, level: int, replies: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the windows whose key's bit is set; (keys, inverse, bits) before."""
        keys, inverse = np.unique(self.key(level), return_inverse=True)
        bits = np.zeros(len(keys), bool)
        mine = {r["bucket"]: r["bits"] for r in replies if r["level"] == level}
        at = 0
        for b in sorted(mine):
            part = np.unpackbits(np.frombuffer(mine[b][8:], np.uint8))[:int.from_bytes(mine[b][:8], "little")]
            bits[at:at + len(part)] = part
            at += len(part)
        return keys, inverse, bits


def _ask(level: int, window: int, seed: int, n_buckets: int):
    """Requests of a chunk: its distinct keys, and per key whether several of
    the chunk's documents have it or, at the last level, their smallest
    identifier."""
    def fn(row, replies):
        import pyarrow as pa
        c = ChunkWindows(row, window, seed)
        for k in range(level):
            _, inverse, bits = c.narrow(k, replies)
            c.at = c.at[bits[inverse]]
        keys, inverse = np.unique(c.key(level), return_inverse=True)
        doc = c.doc[c.at]
        if level == len(c.lengths) - 1:
            extra = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(extra, inverse, c.ids[doc])
        else:
            low, high = np.full(len(keys), len(c.ids)), np.full(len(keys), -1)
            np.minimum.at(low, inverse, doc)
            np.maximum.at(high, inverse, doc)
            extra = (high > low).astype(np.uint8)
        out = [(b, pack_sorted(keys[i:j]), pack(extra[i:j])) for b, i, j in split_sorted(keys, n_buckets)]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()),
                         "chunk": pa.array([row["chunk"]] * len(out), pa.int64()),
                         "hashes": pa.array([o[1] for o in out], pa.binary()),
                         "extra": pa.array([o[2] for o in out], pa.binary())})
    return fn


def _answer(level: int, last: bool):
    """Replies of a bucket: per key of a request, whether another document of
    the corpus has it (last level: one with a smaller identifier than any of
    the chunk's)."""
    def fn(requests):
        import pyarrow as pa
        rows = requests.select(["chunk", "bucket", "hashes", "extra"]).to_pylist()
        hashes = [unpack_sorted(r["hashes"]) for r in rows]
        extra = [unpack(r["extra"], np.int64 if last else np.uint8) for r in rows]
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        size = np.diff(np.append(head, len(ranked)))
        values = np.concatenate(extra)
        if last:
            least = np.minimum.reduceat(values[order], head)
            bit = np.repeat(least, size) < values[order]
        else:
            many = (size > 1) | (np.maximum.reduceat(values[order], head) > 0)
            bit = np.repeat(many, size)
        bits = np.empty(len(every), bool)
        bits[order] = bit
        out, at = [], 0
        for r, h in zip(rows, hashes):
            part = bits[at:at + len(h)]
            at += len(h)
            out.append((r["chunk"], r["bucket"], int(part.sum()), len(h).to_bytes(8, "little") + np.packbits(part).tobytes()))
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()),
                         "level": pa.array([level] * len(out), pa.int32()),
                         "bucket": pa.array([o[1] for o in out], pa.int32()),
                         "n_live": pa.array([o[2] for o in out], pa.int64()),
                         "bits": pa.array([o[3] for o in out], pa.binary())})
    return fn


def _cut(window: int, seed: int, alive: bool):
    def fn(row, replies):
        import pyarrow as pa
        c = ChunkWindows(row, window, seed)
        n = len(c.start)
        gone = np.zeros(n, bool)
        if alive and len(c.at):
            last = len(c.lengths) - 1
            for k in range(last):
                _, inverse, bits = c.narrow(k, replies)
                c.at = c.at[bits[inverse]]
            keys, inverse, bits = c.narrow(last, replies)
            doc = c.ids[c.doc[c.at]]
            least = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, doc)
            copies = c.at[bits[inverse] | (doc > least[inverse])]
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, copies, 1)
            np.add.at(cover, copies + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
        # bytes of kept words, and after each the next byte as a space
        data = np.append(c.data, np.uint8(32))
        kept = np.zeros(len(data) + 1, np.int8)
        s, e = c.start[~gone], c.end[~gone]
        ends_doc = np.isin(e, c.off)
        kept[s] += 1
        kept[e + ~ends_doc] -= 1                # a document's last byte has no byte after it
        mask = np.cumsum(kept[:-1]).astype(bool)
        data = data.copy()
        data[e[~ends_doc]] = 32
        sizes = np.concatenate([[0], np.cumsum(mask)])[c.off]
        packed = data[mask].tobytes()
        texts = [packed[a:b].removesuffix(b" ").decode("utf-8", "replace") for a, b in zip(sizes, sizes[1:])]
        removed = np.bincount(c.doc[gone], minlength=len(c.ids)) if n else np.zeros(len(c.ids), np.int64)
        none = c.ids == np.iinfo(np.int64).max
        return pa.table({"_id": pa.array(c.ids, pa.int64(), mask=none),
                         "n_words": pa.array(np.diff(c.first), pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})
    return fn


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                    seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also
    starts in a document with a smaller identifier (judged on the input).

    Returns one row per input row: ``id_col`` (long), n_words, n_removed,
    kept_text (the kept words, one space between them).  Identifiers must be
    integers; a NULL identifier counts as larger than any other, and rows with
    equal identifiers (or several NULLs) never take words from each other.
    NULL and empty texts have no words.  A document with fewer words than the
    window loses none.  An empty table gives an empty result; other columns are
    not read.  Words are compared by 64-bit hashes of their runs."""
    if window < 2:
        raise ValueError("window must be at least 2 words")
    chunks = chunk_table(docs, id_col, text_col, chunk_bytes=chunk_bytes)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = buckets_for(total, BUCKET_BYTES, shuffle_partitions(docs.sparkSession))
    steps = levels(window, seed)
    replies, alive = None, True
    for k in range(len(steps)):
        asked = per_chunk(chunks, replies, _ask(k, window, seed, n_buckets), _REQUEST)
        answer = stored(asked.groupBy("bucket").applyInArrow(_answer(k, k == len(steps) - 1), _REPLY), f"runs-{k}")
        replies = answer if replies is None else replies.unionByName(answer)
        if k < len(steps) - 1 and not (answer.agg(F.sum("n_live")).first()[0] or 0):
            alive = False                       # no candidate survives
            break
    schema = "_id long, n_words long, n_removed long, kept_text string"
    out = per_chunk(chunks, replies, _cut(window, seed, alive), schema)
    return out.withColumnRenamed("_id", id_col)

"""Best-fit packing of token sequences under several capacities.

Documents are tokenised in Arrow batches and cut into pieces of at most the
sequence length.  Pieces are dealt by hash to shards of a fixed number of
pieces, and every shard is packed on its own by vector best fit: pieces in
decreasing length go to the open bin that fits under every capacity (tokens,
documents, attention cost) and scores best, by the weighted norm of what it
would have left or by the weighted dot product of demand and residual.  Only a
shard's last few bins stay part-empty, so the loss does not grow with the data.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, small_batches, stored

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"                 # the same vocabulary
END_ID = 2
SHARD_PIECES = 8192
CACHE_UNITS = 250_000                           # cached words per Python worker

_GAP = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str | None, "Encoder"] = {}


class Encoder:
    """Token ids of whole texts, as the ``tokenizers`` file at ``path`` gives them.

    The byte-level pattern never joins characters across a single space that
    has non-space characters on both sides, so a text is encoded unit by unit
    (the text up to such a space; the space goes to the next unit) and the
    units' ids are cached.  New units are encoded many at a time: joined by
    spaces with ``tiktoken``, if ``ranks`` is the same vocabulary as ranks, and
    taken apart where a token begins with a space; the other units by
    ``tokenizers`` itself."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.spaced = np.zeros(max(table.values()) + 1, bool)
            self.spaced[[i for t, i in table.items() if t[:1] == b" "]] = True
        self.rests: dict[str, bytes | None] = {}        # of units after a space; None: not a unit by itself

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def inner(self, unit: str) -> bytes:
        """Ids of a unit that a careful split gave (it may end in white space)."""
        known = self.rests[unit]
        return self._slow([" " + unit])[0] if known is None else known

    def _learn(self, split: list[list[str]]) -> None:
        cache = self.rests
        units: set = set()
        for u in split:
            units.update(u[1:])
        new = [u for u in units if u not in cache]
        plain, other = [], []
        for u in new:
            if not u or u[0].isspace() or u[-1].isspace():
                cache[u] = None
            elif self.fast is None or " " in u or any(t in u for t in self.special):
                other.append(u)
            else:
                plain.append(u)
        for lo in range(0, len(plain), 256):
            part = plain[lo:lo + 256]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(part)), "<u4")
            cut = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 4
            if len(cut) != len(part) + 1:       # a token with a space inside: not a byte-level vocabulary
                other += part
                continue
            raw, cut = ids.tobytes(), cut.tolist()
            for u, a, b in zip(part, cut, cut[1:]):
                cache[u] = raw[a:b]
        for lo in range(0, len(other), 4096):
            part = other[lo:lo + 4096]
            cache.update(zip(part, self._slow([" " + u for u in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        split = [t.split(" ") for t in texts]
        heads = self._slow([u[0] for u in split])
        if len(self.rests) > CACHE_UNITS:
            self.rests.clear()
        self._learn(split)
        rest = self.rests.__getitem__
        out, odd = [], []
        for i, (head, u) in enumerate(zip(heads, split)):
            try:
                if u[0][-1:].isspace() or not u[0] and len(u) > 1:
                    raise TypeError
                out.append(head + b"".join(map(rest, u[1:])))
            except TypeError:                   # spaces beside white space: split with care
                out.append(b"")
                odd.append(i)
        if odd:
            careful = [_GAP.split(texts[i]) for i in odd]
            self._learn(careful)
            for i, head, u in zip(odd, self._slow([u[0] for u in careful]), careful):
                out[i] = head + b"".join(map(self.inner, u[1:]))
        return out


def encoder(path: str | None) -> Encoder:
    """The worker's encoder for a ``tokenizers`` file (the default vocabulary if None)."""
    if path not in _ENCODERS:
        if path is None:
            import public_tokenizers
            _ENCODERS[path] = Encoder(public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))
        else:
            _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cut(tokenizer: str | None, length: int, end_id: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        enc = encoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        for rb in batches:
            for lo in range(0, rb.num_rows, 256):
                part = rb.slice(lo, 256)
                texts = pc.fill_null(part.column("_t"), "").to_pylist()
                at, piece, start, size, crc = [], [], [], [], []
                for i, raw in enumerate(enc.encode(texts)):
                    raw += tail
                    n = len(raw) // 4
                    first = (n - 1) % length + 1
                    edges = [0, *range(first, n + 1, length)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        at.append(i)
                        piece.append(k)
                        start.append(a)
                        size.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a:4 * b]))
                if at:
                    yield pa.record_batch({
                        "_id": part.column("_id").take(pa.array(at)), "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64())})
    return run


def token_pieces(docs: DataFrame, length: int = 1024, tokenizer: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32.  A text's
    ids and one ``end_id`` follow each other; a longer document is cut into
    pieces of ``length`` ids, the first of which takes the remainder."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    cut = src.mapInArrow(_cut(tokenizer, length, end_id),
                         f"_id {kind}, piece int, start long, length long, ids_crc32 long")
    return cut.withColumnRenamed("_id", id_col)


def vector_best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin of every item (rows of ``demand``, in the given order).

    An item joins the open bin with room in every dimension and the smallest
    weighted norm of the room left (``norm``), or the largest weighted dot
    product of demand and room (``dot``), the oldest bin on ties; else it opens
    a bin.  Every item must fit into an empty bin."""
    n = len(demand)
    d = demand / capacity
    out = np.empty(n, np.int64)
    smallest = np.minimum.accumulate(demand[::-1], axis=0)[::-1] if n else demand   # of the items to come
    room = np.empty((n, demand.shape[1]))
    ids = np.empty(n, np.int64)
    n_open = n_bins = 0
    for i in range(n):
        open_room = room[:n_open]
        fits = np.flatnonzero((open_room >= demand[i]).all(axis=1)) if n_open else ()
        if len(fits):
            left = open_room[fits] / capacity
            score = ((left - d[i]) ** 2 @ weights) if rule == "norm" else -(left * d[i]) @ weights
            b = fits[int(np.argmin(score))]
        else:
            b, n_open = n_open, n_open + 1
            room[b], ids[b] = capacity, n_bins
            n_bins += 1
        room[b] -= demand[i]
        out[i] = ids[b]
        if i + 1 < n and (room[b] < smallest[i + 1]).any():     # nothing to come fits: close it
            room[b:n_open - 1] = room[b + 1:n_open].copy()
            ids[b:n_open - 1] = ids[b + 1:n_open].copy()
            n_open -= 1
    return out


def _pack_shard(length: int, max_documents: int, max_cost: float, weights: tuple, rule: str):
    capacity = np.array([length, max_documents, max_cost], float)
    w = np.array(weights, float)

    def run(pdf):
        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        size = pdf["length"].to_numpy(np.int64)
        demand = np.stack([size, np.ones(len(size)), size.astype(float) ** 2], axis=1)
        bins = vector_best_fit(demand, capacity, w, rule)
        order = np.argsort(bins, kind="stable")
        run_start = np.concatenate([[0], np.flatnonzero(np.diff(bins[order])) + 1]).astype(int)
        total = np.cumsum(size[order]) - size[order]
        offset = np.empty(len(size), np.int64)
        offset[order] = total - np.repeat(total[run_start], np.diff(np.append(run_start, len(size))))
        pdf["sequence_id"] = (pdf["_shard"].to_numpy(np.int64) << 32) + bins
        pdf["offset"] = offset
        return pdf.drop(columns=["_shard", "_row"])
    return run


def pack_documents(docs: DataFrame, length: int = 1024, max_documents: int | None = None, max_cost: float | None = None,
                   weights: tuple[float, float, float] = (1.0, 1 / 64, 1 / 64), rule: str = "norm",
                   tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` ids.

    Returns one row per piece: ``id_col``, piece, start, length, ids_crc32,
    sequence_id, offset.  ``max_documents`` bounds the pieces in a sequence and
    ``max_cost`` the sum of squared lengths (by default both hold whenever the
    token capacity does).  NULL text counts as empty, and an empty text is one
    piece that holds the end id alone.  Identifiers may be NULL or repeated:
    every row is packed.  An empty table gives an empty result, and other
    columns are not read."""
    if max_cost is not None and max_cost < length * length:
        raise ValueError("max_cost must allow one full piece")
    if max_documents is not None and max_documents < 1:
        raise ValueError("max_documents must be at least 1")
    pieces = token_pieces(docs, length, tokenizer, id_col=id_col, text_col=text_col)
    # tokenised once; the row numbers are fixed from here on
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    shards = buckets_for(pieces.count(), shard_pieces)
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row")
    return dealt.groupBy("_shard").applyInPandas(
        _pack_shard(length, max_documents or length, float(max_cost or length * length), weights, rule),
        schema + ", sequence_id long, offset long")

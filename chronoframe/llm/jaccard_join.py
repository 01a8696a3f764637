"""N-gram Jaccard join by chosen paths.

Every document is the set of its word shingles, embedded as 128 min-hash
tokens, so that two sets share a token with a probability equal to their
Jaccard similarity.  One run splits the sets recursively on sampled tokens:
sets that share the token stay together, a set alone in its bucket leaves, a
small bucket is compared by brute force, and a large one is split again, up to
a fixed depth.  Runs are repeated until a pair at the threshold is found with
the target recall.  Brute force compares one-byte sketches of the tokens;
every candidate pair belongs to the first run that brings it together, and is
verified there against the whole shingle sets.

Documents with equal shingle sets are one class from the start.  No table has
a row per pair: a bucket returns, per member, its number of links and a root
of its links, and buckets too large for one task are compared block by block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NO_ID, chunk_table, per_chunk, read_chunk
from .common import stored
from .components import connected_components
from .words import U64, gram_hashes, mix, pack, pack_sorted, unpack, unpack_sorted, word_hashes, word_spans

TOKENS = 128                                    # min-hash tokens of a set
DEPTH = 4                                       # splits of a path
SMALL = 64                                      # sets that are compared at once
BLOCK = 192                                     # sets of a block of a larger bucket
DEALT_ROWS = 20_000                             # rows that a task holds while it deals buckets
MARGIN = 4.5                                    # standard errors of the sketch below the threshold

_MUL = np.random.default_rng(5).integers(1, 2**63, TOKENS, dtype=np.uint64) * U64(2) + U64(1)


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold that needs every split has met
    with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** DEPTH)))


def _positions(runs: int) -> np.ndarray:
    """Token of every run and depth."""
    return (np.arange(runs * DEPTH) * 37 % TOKENS).reshape(runs, DEPTH)


def shingle_sets(row: dict, n: int):
    """(document identifiers, ascending distinct shingle hashes of a document,
    bytes of a document), the latter two by its place.  A text of fewer than ``n`` words is one shingle of them all."""
    ids, data, off = read_chunk(row["ids"], row["sizes"], row["texts"])
    s, e, first = word_spans(data, off)
    words = word_hashes(data, s, e)
    grams = gram_hashes(words, n)

    def of(i: int) -> np.ndarray:
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            return np.unique(grams[a:b - n + 1])
        if b > a:
            return mix(gram_hashes(words[a:b], b - a) + U64(b - a))
        return np.zeros(0, np.uint64)
    return ids, of, lambda i: data[off[i]:off[i + 1]].tobytes()


def min_tokens(shingles: np.ndarray) -> np.ndarray:
    best = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(shingles), 4096):
        part = ((shingles[None, lo:lo + 4096] * _MUL[:, None]) >> U64(32)).astype(np.uint32)
        np.minimum(best, part.min(axis=1), out=best)
    return best


def _row_numbers(chunk: int, n: int) -> np.ndarray:
    """Numbers of a chunk's documents: 21 bits of task, 20 of chunk, 22 of place."""
    task, seq = chunk >> 33, chunk & ((1 << 33) - 1)
    return (task << 42) + (seq << 22) + np.arange(n)


def _chunk_of(u):
    return F.shiftleft(F.shiftright(u, 42), 33) + F.shiftright(u, 22).bitwiseAND(F.lit((1 << 20) - 1))


def _signatures(n: int):
    def fn(row, _):
        import pyarrow as pa
        ids, of, raw = shingle_sets(row, n)
        keys, sizes, tokens, digests = [], [], [], []
        for i in range(len(ids)):
            h = of(i)
            digests.append(hashlib.sha256(raw(i)).digest())
            m = mix(h)
            keys.append(np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(m), len(h)], np.uint64).tobytes())
            sizes.append(len(h))
            tokens.append(min_tokens(h).tobytes())
        return pa.table({"u": pa.array(_row_numbers(row["chunk"], len(ids)), pa.int64()),
                         "id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                         "key": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int64()),
                         "sha": pa.array(digests, pa.binary()), "tokens": pa.array(tokens, pa.binary())})
    return fn


def _paths(runs: int):
    pos = _positions(runs)

    def run(batches):
        import pyarrow as pa
        for rb in batches:
            if rb.num_rows == 0:
                continue
            u = rb.column("u").to_numpy()
            t = np.frombuffer(b"".join(rb.column("tokens").to_pylist()), np.uint32).reshape(len(u), TOKENS).astype(np.uint64)
            for r in range(runs):
                path = np.full(len(u), mix(np.array([r + 1], np.uint64))[0])
                cols = {"u": pa.array(u), "run": pa.array(np.full(len(u), r, np.int32))}
                for k in range(DEPTH):
                    path = mix(path * U64(0x9E3779B97F4A7C15) + t[:, pos[r, k]])
                    cols[f"p{k}"] = pa.array(path.view(np.int64))
                yield pa.record_batch(cols)
    return run


def _whole_groups(batches, key: str):
    """Tables of whole groups of a partition sorted by ``key``."""
    import pyarrow as pa
    held: list = []
    for rb in batches:
        if rb.num_rows == 0:
            continue
        k = rb.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], side="left"))
        first_ends = bool(held) and held[-1].column(key)[-1].as_py() != k[0]
        if cut or first_ends:
            done = [*held, *([rb.slice(0, cut)] if cut else [])]
            if done:
                yield pa.Table.from_batches(done)
            held = []
        held.append(rb.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _candidates(runs: int, threshold: float):
    """Members and candidate pairs of every group of a partition."""
    error = math.sqrt(threshold * (1 - threshold) / TOKENS)
    least = (threshold - MARGIN * error) * TOKENS

    def owned(a, b, sketch, bucket, block, run, cross):
        """Index pairs that resemble each other, and meet here first."""
        ok = block[a] != block[b] if cross else np.ones(len(a), bool)
        a, b = a[ok], b[ok]
        keep = []
        for lo in range(0, len(a), 1 << 15):
            x, y = a[lo:lo + (1 << 15)], b[lo:lo + (1 << 15)]
            near = (sketch[x] == sketch[y]).sum(axis=1) >= least
            x, y = x[near], y[near]
            met = (bucket[x] == bucket[y]) & (bucket[x] != 0)
            first = met.argmax(axis=1) == run[x]
            keep.append((x[first], y[first]))
        return (np.concatenate([k[0] for k in keep]), np.concatenate([k[1] for k in keep])) if keep else (a[:0], b[:0])

    def table(t):
        import pyarrow as pa
        t = t.combine_chunks()
        n = t.num_rows
        col = {c: t.column(c).to_numpy() for c in ("g", "u", "block", "run", "copies", "cross")}
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, TOKENS)
        bucket = np.frombuffer(b"".join(t.column("buckets").to_pylist()), np.int64).reshape(n, runs)
        edge = _bounds(col["g"])
        size = np.diff(edge)
        found = []
        for s in np.unique(size[size > 1]):
            starts = edge[:-1][size == s]
            i, j = np.triu_indices(s, 1)
            step = max(1, (1 << 18) // len(i))
            for lo in range(0, len(starts), step):
                at = starts[lo:lo + step, None]
                a, b = (at + i).ravel(), (at + j).ravel()
                for flag in (False, True):
                    use = col["cross"][a] == flag
                    if use.any():
                        found.append(owned(a[use], b[use], sketch, bucket, col["block"], col["run"], flag))
        if not found:
            return
        a = np.concatenate([f[0] for f in found])
        b = np.concatenate([f[1] for f in found])
        if not len(a):
            return
        group = np.searchsorted(edge, a, side="right") - 1
        order = np.argsort(group, kind="stable")
        a, b, group = a[order], b[order], group[order]
        cut = _bounds(group)
        gs, members, copies, pairs = [], [], [], []
        for x, y in zip(cut, cut[1:]):
            rows, slot = np.unique(np.concatenate([a[x:y], b[x:y]]), return_inverse=True)
            gs.append(int(col["g"][a[x]]))
            members.append(col["u"][rows])
            copies.append(col["copies"][rows])
            pairs.append(pack(slot.astype(np.uint16)))
        flat = np.concatenate(members)
        count = [len(m) for m in members]
        yield pa.record_batch({
            "g": pa.array(np.repeat(np.array(gs, np.int64), count)), "u": pa.array(flat, pa.int64()),
            "slot": pa.array(np.concatenate([np.arange(c) for c in count]), pa.int32()),
            "copies": pa.array(np.concatenate(copies), pa.int64()), "data": pa.nulls(len(flat), pa.binary())})
        yield pa.record_batch({
            "g": pa.array(gs, pa.int64()), "u": pa.nulls(len(gs), pa.int64()), "slot": pa.array([-1] * len(gs), pa.int32()),
            "copies": pa.nulls(len(gs), pa.int64()), "data": pa.array(pairs, pa.binary())})

    def run(batches):
        for t in _whole_groups(batches, "g"):
            yield from table(t)
    return run


def _fetch(n: int):
    """Shingle sets of the documents that a chunk is asked for."""
    def fn(row, asked):
        import pyarrow as pa
        _, of, _ = shingle_sets(row, n)
        cache: dict[int, bytes] = {}
        data = []
        for q in asked:
            i = q["u"] & ((1 << 22) - 1)
            if i not in cache:
                cache[i] = pack_sorted(of(i))
            data.append(cache[i])
        return pa.table({"g": pa.array([q["g"] for q in asked], pa.int64()), "u": pa.array([q["u"] for q in asked], pa.int64()),
                         "slot": pa.array([q["slot"] for q in asked], pa.int32()),
                         "copies": pa.array([q["copies"] for q in asked], pa.int64()), "data": pa.array(data, pa.binary())})
    return fn


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``a`` and ``b``."""
    if len(a) <= 3 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    total = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(column.max()) + 1, 8192):     # dense blocks of 8192 shingles
        use = (column >= lo) & (column < lo + 8192)
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[use], column[use] - lo] = 1
        total += m @ m.T
    return total[a, b].astype(np.int64)


def _verify(threshold: float):
    def group(rows):
        members = sorted((r for r in rows if r["slot"] >= 0), key=lambda r: r["slot"])
        slots = np.concatenate([unpack(r["data"], np.uint16) for r in rows if r["slot"] < 0]).astype(np.int64)
        a, b = slots[:len(slots) // 2], slots[len(slots) // 2:]
        sets = [unpack_sorted(r["data"]) for r in members]
        size = np.array([len(s) for s in sets])
        both = shared_counts(sets, a, b)
        ok = both >= threshold * (size[a] + size[b] - both) - 1e-9
        a, b = a[ok], b[ok]
        copies = np.array([r["copies"] for r in members])
        links = np.bincount(a, copies[b], len(sets)) + np.bincount(b, copies[a], len(sets))
        root = np.arange(len(sets))
        while len(a):
            least = np.minimum(root[a], root[b])
            after = root.copy()
            np.minimum.at(after, a, least)
            np.minimum.at(after, b, least)
            after = after[after]
            if (after == root).all():
                break
            root = after
        return [(m["u"], int(x), members[k]["u"]) for m, x, k in zip(members, links, root) if x]

    def run(batches):
        import pyarrow as pa
        for t in _whole_groups(batches, "g"):
            t = t.combine_chunks()
            edge = _bounds(t.column("g").to_numpy())
            out = []
            for lo, hi in zip(edge, edge[1:]):
                out += group(t.slice(lo, hi - lo).to_pylist())
            if out:
                yield pa.record_batch({"u": pa.array([o[0] for o in out], pa.int64()),
                                       "links": pa.array([o[1] for o in out], pa.int64()),
                                       "v": pa.array([o[2] for o in out], pa.int64())})
    return run


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, id_col: str = "doc_id",
                 text_col: str = "text", seed_small: int = SMALL) -> DataFrame:
    """Groups of documents whose sets of ``n``-word shingles have a Jaccard
    similarity of ``threshold`` or more.

    Returns one row per input row: ``id_col`` (long), class_id (the smallest
    identifier among all documents joined to it by chains of links), n_links
    (other rows whose similarity reaches the threshold), class_size, text_sha256,
    kept (one row per class: its first row with the smallest identifier).  Words are
    compared unchanged; a text with fewer than ``n`` words is one shingle of
    them all; a text without words (or NULL) has no links and is a class of its
    own.  Repeated rows link to each other; a NULL identifier sorts after all
    others and gives a NULL class_id only to a class without another one.  An
    empty table gives an empty result; other columns are not read.  Reported
    links are exact; a pair at the threshold is found with probability
    ``recall`` or more."""
    runs = runs_for(threshold, recall)
    chunks = chunk_table(docs, id_col, text_col)
    rows = stored(per_chunk(chunks, None, _signatures(n), "u long, id long, key binary, n long, sha binary, tokens binary"), "sets")
    first = F.min(F.struct(F.coalesce(F.col("id"), F.lit(int(NO_ID))).alias("id"), F.col("u")))
    classes = stored(rows.where("n > 0").groupBy("key").agg(
        first["u"].alias("u"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens")), "classes")

    # recursive splitting: stored buckets of every depth; the first depth's paths
    # are cheaper to hash twice than to store
    active = classes.select("u", "tokens").mapInArrow(
        _paths(runs), "u long, run int, " + ", ".join(f"p{k} long" for k in range(DEPTH)))
    buckets = None
    for k in range(DEPTH):
        p = f"p{k}"
        size = active.groupBy(p).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = stored(active.join(size, p), f"met-{k}")
        ends = met if k == DEPTH - 1 else met.where(F.col("size") <= seed_small)
        ends = ends.select("u", "run", F.col(p).alias("bucket"), "size")
        buckets = ends if buckets is None else buckets.unionByName(ends)
        active = met.where(F.col("size") > seed_small).drop("size")

    # a document's buckets, one entry per run at most
    mine = buckets.groupBy("u").agg(F.collect_list(F.struct("run", "bucket", "size")).alias("at"))
    mine = mine.join(classes, "u").select("u", "copies", "at", "tokens").mapInArrow(
        _deal(runs), "g long, u long, block int, run int, cross boolean, copies long, sketch binary, buckets binary")
    found = stored(mine.repartition("g").sortWithinPartitions("g").mapInArrow(
        _candidates(runs, threshold), "g long, u long, slot int, copies long, data binary"), "candidates")
    members = found.where("slot >= 0").select(_chunk_of(F.col("u")).alias("chunk"), "g", "u", "slot", "copies")
    sets = per_chunk(chunks, members, _fetch(n), "g long, u long, slot int, copies long, data binary")
    proven = sets.unionByName(found.where("slot < 0")).repartition("g").sortWithinPartitions("g").mapInArrow(
        _verify(threshold), "u long, links long, v long")
    proven = stored(proven, "links")

    root = connected_components(proven.select("u", "v"))
    links = proven.groupBy("u").agg(F.sum("links").alias("links"))
    found_in = classes.select("key", "u", "copies").join(links, "u", "left").join(root, "u", "left").select(
        "key", F.coalesce("root", "u").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # a row without words is its own class
    placed = rows.select("u", "id", "key", "n", "sha").join(found_in, "key", "left").select(
        "u", "id", "sha", F.coalesce("root", "u").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    placed = stored(placed, "placed")
    whole = placed.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(whole, "root").select(
        F.col("id").alias(id_col),
        F.when(F.col("first.id") != F.lit(int(NO_ID)), F.col("first.id")).alias("class_id"), "n_links", "class_size",
        F.lower(F.hex("sha")).alias("text_sha256"), (F.col("u") == F.col("first.u")).alias("kept"))


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, without all but one row of every class that
    :func:`jaccard_join` finds."""
    def key(sha, i):
        return F.concat_ws(":", sha, F.coalesce(i.cast("string"), F.lit("null"))).alias("_key")

    kept = jaccard_join(docs, n, threshold, recall, id_col, text_col).where("kept").select(
        key(F.col("text_sha256"), F.col(id_col))).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       key(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256), F.col(f"`{id_col}`").cast("long")))
    # one shuffle of the texts: the grouping keeps the join's partitioning; rows
    # that repeat identifier and text are one
    return rows.join(kept, "_key").groupBy("_key").agg(F.first("_doc").alias("_doc")).select("_doc.*")


def _deal(runs: int):
    """Rows of a document's buckets; those of a bucket larger than a block go
    to every pair of blocks that its own block is part of."""
    def flushed(out):
        import pyarrow as pa
        return pa.record_batch({
            "g": pa.array(out["g"], pa.int64()), "u": pa.array(out["u"], pa.int64()), "block": pa.array(out["block"], pa.int32()),
            "run": pa.array(out["run"], pa.int32()), "cross": pa.array(out["cross"]), "copies": pa.array(out["copies"], pa.int64()),
            "sketch": pa.array(out["sketch"], pa.binary()), "buckets": pa.array(out["buckets"], pa.binary())})

    def run(batches):
        names = ("g", "u", "block", "run", "cross", "copies", "sketch", "buckets")
        out = {c: [] for c in names}
        for rb in batches:
            for u, copies, at, tokens in zip(*(rb.column(c).to_pylist() for c in ("u", "copies", "at", "tokens"))):
                own = np.zeros(runs, np.int64)
                for x in at:
                    own[x["run"]] = x["bucket"]
                sketch = np.frombuffer(tokens, np.uint32).astype(np.uint8).tobytes()
                packed = own.tobytes()
                for x in at:
                    blocks = -(-x["size"] // BLOCK)
                    b = int(mix(np.array([u], np.uint64))[0]) % blocks if blocks > 1 else 0
                    for j in range(blocks):
                        lo, hi = min(b, j), max(b, j)
                        g = (x["bucket"] + lo * 0x9E3779B97F4A7C15 + hi * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1)
                        row = (g - (1 << 64) if g >> 63 else g, u, b, x["run"], lo != hi, copies, sketch, packed)
                        for c, v in zip(names, row):
                            out[c].append(v)
                        if len(out["g"]) >= DEALT_ROWS:         # a large bucket's rows leave in bounded batches
                            yield flushed(out)
                            out = {c: [] for c in names}
        if out["g"]:
            yield flushed(out)
    return run

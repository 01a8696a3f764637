"""Language-model scoring by Katz backoff.

Counts: every chunk of documents is split into words once and kept as the
places of its tokens among its distinct words.  It sends those words, and then
level by level its distinct n-grams, with their training counts to buckets of
the hash space; a bucket adds them up and answers every chunk in the order of
its request.  The answers and the buckets' tables are stored, partitioned by
bucket; a chunk's row then takes up its answers, and the tables of the level
before are deleted.  The chunks' rows are bucketed by chunk and never shuffled
again: only requests and answers move.  Words and the n-grams seen in training get dense numbers,
so that an n-gram is one 64-bit key: the number of its history and that of its
last word.

Model: P(w | h) = d(c) c(h w) / c(h) for an n-gram seen in training, else
alpha(h) P(w | h'), where h' is h without its first word and alpha(h) gives
the mass that discounting freed to the words not seen after h, exactly:
alpha(h) = (1 - sum of the seen n-grams' probabilities) / (1 - sum of
P(. | h') over the same words).  An unseen history leaves P(w | h') as it is.
P(w) = d(c) c(w) / N for a seen word, and what is left goes to the one unknown
word.  The discounts d are Good-Turing's for counts up to five (Katz 1987),
with their own counts of counts at each level.  A history without a discounted
n-gram, or a level whose counts of counts allow no valid discounts, adds one
to its total instead and so keeps the same identity.  A text begins with one
start symbol: its first word has that as its only history, at any order.

An n-gram is seen only if the shorter one without its first word is, so the
sum over the seen words of P(. | h') is that of d(c) c of the shorter n-grams
over one total, and requests carry counts only.
"""

from __future__ import annotations

from copy import copy

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import NO_ID, chunk_table, per_chunk, read_chunk, split_sorted
from .common import Bucketed, buckets_for, shuffle_partitions, stored, temporary
from .words import U64, mix, pack, pack_sorted, unpack, unpack_sorted, word_hashes, word_spans

TOP = 5                                         # largest discounted count
BUCKET_BYTES = 64 << 20                         # text per bucket
CHUNK_BYTES = 6 << 20
TASK_CHUNKS = 32                                # chunks in a bucket of the chunks' tables, at most about
HOT_SHARE = 1000                                # a history with more than 1/1000 of all tokens is split by word
END = mix(np.array([0x454E44], np.uint64))[0]
_ANSWER = ("level int, hot boolean, chunk long, bucket int, a binary, b binary, c binary, d binary, "
           "n_types long, n_tokens long, counts array<bigint>, hist long, seen array<bigint>, lower double")


def discounts(counts: list[int], top: int = TOP) -> np.ndarray:
    """Discount ratio by count (index 0 unused, 1 beyond ``top``) from the
    counts of counts n_1, n_2, ...; the largest limit up to ``top`` with all
    ratios inside (0, 1), or none."""
    n = [0, *counts]
    for k in range(top, 1, -1):
        if k + 1 >= len(n) or not all(n[r] > 0 for r in range(1, k + 2)):
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        if tail >= 1:
            continue
        d = [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d, *[1.0] * (top - k)])
    return np.ones(top + 1)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= TOP, d[np.clip(c, 0, TOP)], 1.0)


class Unigrams:
    """P(w) from a word's training count."""

    def __init__(self, n_tokens: int, n_types: int, counts: list[int]):
        self.n, self.v, self.d = n_tokens, n_types, discounts(counts)
        freed = sum(n * r * (1 - self.d[r]) for r, n in enumerate(counts[:TOP], 1))
        self.total = n_tokens if freed > 0 else n_tokens + 1
        self.unknown = (freed if freed > 0 else 1) / self.total

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.unknown)


def _tokenized(row: dict, _):
    """A chunk's token stream, every document's folded words and one end, as
    places among its distinct words."""
    import pyarrow as pa
    _, data, off = read_chunk(row["ids"], row["sizes"], row["texts"])
    s, e, first = word_spans(data, off)
    n = np.diff(first) + 1
    is_end = np.zeros(int(n.sum()), bool)
    is_end[np.cumsum(n) - 1] = True
    stream = np.empty(len(is_end), np.uint64)
    stream[is_end] = END
    stream[~is_end] = word_hashes(data, s, e, fold=True)
    types, _, at = _distinct(stream)
    cells = {"ids": row["ids"], "flags": row["flags"], "lengths": pack(n.astype(np.int64)),
             "at": pack(at.astype(np.uint32)), "types": pack_sorted(types)}
    return pa.table({"chunk": pa.array([row["chunk"]], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in cells.items()}})


class Tokens:
    """Token stream of a chunk: every document's folded words and one end."""

    def __init__(self, row: dict):
        self.ids, n = unpack(row["ids"], np.int64), unpack(row["lengths"], np.int64)
        self.n_tokens = n
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.head = np.cumsum(n) - n            # first token of every document
        self.train = unpack(row["flags"], np.uint8).astype(bool)
        self.at = unpack(row["at"], np.uint32)

    def numbered(self, replies: list[dict], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, training count) of every token's word; ``base`` is
        the first number of every bucket."""
        number, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in sorted((r for r in replies if r["level"] == 1), key=lambda r: r["bucket"]):
            c = unpack(r["b"], np.uint32).astype(np.int64)
            number.append(np.where(c > 0, unpack_sorted(r["a"]).astype(np.int64) + base[r["bucket"]], -1))
            count.append(c)
        return np.concatenate(number)[self.at], np.concatenate(count)[self.at]


class Levels:
    """What all tasks know of the model: how keys are made and dealt, and of
    every finished level the first numbers of its buckets (at level k + 1 those
    of the hot histories follow), its discounts and its hot histories."""

    def __init__(self, n_buckets: int, hot_over: float, lower: Unigrams, base: np.ndarray, n_train_docs: int):
        self.n_buckets, self.hot_over, self.lower, self.n_train_docs = n_buckets, hot_over, lower, n_train_docs
        self.start = lower.v                    # number of the start symbol
        self.bits = (lower.v + 1).bit_length()  # of a word in a key
        self.unknown = (1 << self.bits) - 1
        self.base, self.discounts, self.hot = {1: base}, {1: lower.d}, {}

    @property
    def top(self) -> int:
        return max(self.discounts)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct keys, the place of any one occurrence of each, the
    number of every key): ``np.unique`` without the cost of a stable order."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], order[new], inverse


class Grams:
    """A chunk's distinct n-grams of a level that have a known history, in the
    order of requests: usual histories first, by bucket and key.  token: tokens
    with a known history; at: their n-grams; of every n-gram the key, its
    history, whether that is hot, its bucket, and one of its tokens."""

    def __init__(self, t: Tokens, levels: Levels, level: int, word: np.ndarray, number: np.ndarray, count: np.ndarray):
        """``number`` and ``count`` are those of the n-gram, a level below, that
        ends at a token."""
        before, hot_before = np.full_like(number, -1), np.zeros(len(number), bool)
        before[1:], hot_before[1:] = number[:-1], count[:-1] > levels.hot_over
        before[t.head], hot_before[t.head] = (levels.start, True) if level == 2 else (-1, False)
        self.token = np.flatnonzero(before >= 0).astype(np.int32)
        shift = U64(levels.bits)
        keys = before[self.token].astype(np.uint64) << shift
        # a word not seen after the shorter history is not seen after this one
        keys |= np.where(count[self.token] > 0, word[self.token], levels.unknown).astype(np.uint64)
        del before
        keys, one, inverse = _distinct(keys)
        one = self.token[one]
        hot = hot_before[one]
        place = mix((keys >> shift) * U64(2) + U64(1))
        place[hot] = mix(place[hot] + keys[hot])                # a hot history is spread by word
        group = (place >> U64(32)) * U64(levels.n_buckets) >> U64(32)
        group = (group + hot * U64(levels.n_buckets)).astype(np.min_scalar_type(2 * levels.n_buckets))
        order = np.argsort(group, kind="stable")                # small numbers are sorted in linear time
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.at, self.keys, self.hot, self.one = rank[inverse], keys[order], hot[order], one[order]
        self.bucket = group[order].astype(np.int32) - self.hot * np.int32(levels.n_buckets)
        self.hist = (self.keys >> shift).astype(np.int64)

    def requests(self):
        """(hot, bucket, first, last) of every request."""
        if not len(self.keys):
            return
        cuts = np.flatnonzero((self.bucket[1:] != self.bucket[:-1]) | (self.hot[1:] != self.hot[:-1])) + 1
        edge = [0, *cuts.tolist(), len(self.keys)]
        for i, j in zip(edge, edge[1:]):
            yield bool(self.hot[i]), int(self.bucket[i]), i, j


class Walk:
    """A chunk's tokens at the highest finished level: number and count of the
    n-gram that ends at every token, its probability, and its history's total."""

    def __init__(self, row: dict, replies: list[dict], levels: Levels):
        """``replies`` are those that the chunk's row has not taken up yet."""
        self.t, self.levels, replies = Tokens(row), levels, row["found"] + replies
        self.word, self.words = self.t.numbered(replies, levels.base[1])
        self.number, self.count, self.prob = self.word, self.words, levels.lower(self.words)
        self.total = np.full(len(self.word), float(levels.lower.total))
        for level in range(2, levels.top + 1):
            self.step(level, [r for r in replies if r["level"] == level])

    def grams(self, level: int) -> Grams:
        return Grams(self.t, self.levels, level, self.word, self.number, self.count)

    def step(self, level: int, replies: list[dict]):
        g, d = self.grams(level), self.levels.discounts[level]
        number, count = np.full_like(self.number, -1), np.zeros_like(self.count)
        if len(g.keys):
            mine = sorted(replies, key=lambda r: (r["hot"], r["bucket"]))
            gram_count = np.concatenate([unpack(r["a"], np.uint32) for r in mine]).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (g.hist[1:] != g.hist[:-1]) | (g.hot[1:] != g.hot[:-1])
                                                   | g.hot[1:] & (g.bucket[1:] != g.bucket[:-1])]))
            of_gram = np.zeros(len(g.keys), np.int32)
            of_gram[first[1:]] = 1
            of_gram = np.cumsum(of_gram, dtype=np.int32)
            usual = ~g.hot[first]
            seen, mass = np.zeros((len(first), TOP), np.int64), np.zeros(len(first))
            if usual.any():
                seen[usual] = np.concatenate([unpack(r["c"], np.uint32).reshape(TOP, -1).T for r in mine if not r["hot"]])
                mass[usual] = np.concatenate([_unpack_repeated(r["d"]) for r in mine if not r["hot"]])
            for k in np.flatnonzero(~usual):
                seen[k], mass[k] = self.levels.hot[level][int(g.hist[first[k]])]
            # training count of the history: of the n-gram before, or the documents
            one = g.one[first]
            at_start = np.full(len(one), level == 2) & (g.hist[first] == self.levels.start)
            before = np.where(at_start, self.levels.n_train_docs, self.count[one - 1])
            freed = seen @ (np.arange(1, TOP + 1) * (1 - d[1:]))
            total = np.where(freed > 0, before, before + 1)
            below = self.total[one]             # of the shorter history
            alpha = np.where(freed > 0, freed, 1.0) / total * (below / (below - mass))
            alpha, total = np.where(before > 0, alpha, 1.0), np.maximum(total, 1)
            del mass, seen, freed, before, below
            kept = np.where(gram_count > 0, discounted(gram_count, d) / total[of_gram], alpha[of_gram])[g.at]
            self.prob[g.token] = np.where(gram_count[g.at] > 0, kept, kept * self.prob[g.token])
            self.total[g.token] = total[of_gram[g.at]]
            count[g.token] = gram_count[g.at]
            if level in self.levels.base:
                base = self.levels.base[level]
                local = np.concatenate([unpack_sorted(r["b"]).astype(np.int64) + base[r["bucket"] + self.levels.n_buckets * r["hot"]] for r in mine])
                number[g.token] = np.where(gram_count > 0, local, -1)[g.at]
        self.number, self.count = number, count


def _pack_repeated(x: np.ndarray) -> bytes:
    """Compress floats of which many are equal."""
    values, at = np.unique(x, return_inverse=True)
    head = pack(values)
    return len(head).to_bytes(8, "little") + head + pack(at.astype(np.uint32))


def _unpack_repeated(b: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(b[:8], "little")
    return unpack(b[8:cut], np.float64)[unpack(b[cut:], np.uint32)]


def _answer_kinds() -> dict:
    import pyarrow as pa
    return {"level": pa.int32(), "hot": pa.bool_(), "chunk": pa.int64(), "bucket": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(),
            "d": pa.binary(), "n_types": pa.int64(), "n_tokens": pa.int64(), "counts": pa.list_(pa.int64()), "hist": pa.int64(),
            "seen": pa.list_(pa.int64()), "lower": pa.float64()}


def _answer_table(rows: list[dict]):
    import pyarrow as pa
    return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in _answer_kinds().items()})


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= TOP + 1)], minlength=TOP + 2)[1:].tolist()


def _ask_words(n_buckets: int):
    def fn(row, _):
        import pyarrow as pa
        t, types = Tokens(row), unpack_sorted(row["types"])
        count = np.bincount(t.at[t.train[t.doc]], minlength=len(types)).astype(np.uint32)
        out = [(b, pack_sorted(types[i:j]), pack(count[i:j])) for b, i, j in split_sorted(types, n_buckets)]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()), "chunk": pa.array([row["chunk"]] * len(out), pa.int64()),
                         "keys": pa.array([o[1] for o in out], pa.binary()), "count": pa.array([o[2] for o in out], pa.binary()),
                         "word": pa.nulls(len(out), pa.binary())})
    return fn


def _added_up(rows: list[dict]):
    """(distinct keys, their summed counts, per request the places of its keys,
    per distinct key the place of one occurrence)."""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    every, one, inverse = _distinct(np.concatenate(keys))
    total = np.bincount(inverse, np.concatenate([unpack(r["count"], np.uint32) for r in rows]), len(every)).astype(np.int64)
    cuts = np.cumsum([0] + [len(k) for k in keys])
    return every, total, [inverse[a:b] for a, b in zip(cuts, cuts[1:])], one


def _answer_words(requests):
    rows = requests.select(["bucket", "chunk", "keys", "count"]).to_pylist()
    every, total, places, _ = _added_up(rows)
    bucket = rows[0]["bucket"]
    local = (np.cumsum(total > 0) - 1).clip(0).astype(np.uint64)
    out = [{"level": 1, "chunk": r["chunk"], "bucket": bucket, "a": pack_sorted(local[p]), "b": pack(total[p].astype(np.uint32))}
           for r, p in zip(rows, places)]
    known = total > 0                           # the unigram table of the bucket
    out.append({"level": 1, "bucket": bucket, "a": pack_sorted(every[known]), "b": pack(total[known].astype(np.uint32)),
                "n_types": int(known.sum()), "n_tokens": int(total.sum()), "counts": _counts_of_counts(total)})
    return _answer_table(out)


def _ask_grams(levels: Levels):
    """Requests for the level above the highest finished one."""
    def fn(row, replies):
        import pyarrow as pa
        walk = Walk(row, replies, levels)
        g = walk.grams(levels.top + 1)
        in_training = walk.t.train[walk.t.doc[g.token]]
        seen = np.bincount(g.at[in_training], minlength=len(g.keys)).astype(np.uint32)
        below = walk.count[g.one].astype(np.uint32)
        out = [(h, b, pack_sorted(g.keys[i:j]), pack(seen[i:j]), pack(below[i:j])) for h, b, i, j in g.requests()]
        return pa.table({"bucket": pa.array([o[1] for o in out], pa.int32()), "chunk": pa.array([row["chunk"]] * len(out), pa.int64()),
                         "keys": pa.array([o[2] for o in out], pa.binary()), "count": pa.array([o[3] for o in out], pa.binary()),
                         "word": pa.array([o[4] for o in out], pa.binary()), "hot": pa.array([o[0] for o in out], pa.bool_())})
    return fn


def _taken_up(row: dict, replies: list[dict]):
    """The chunk's row with its answers of one more level."""
    import pyarrow as pa
    found = row.get("found", []) + [{f: r[f] for f in _FOUND} for r in replies]
    kinds = _answer_kinds()
    cells = {c: pa.array([row[c]], pa.int64() if c == "chunk" else pa.binary()) for c in _KEPT}
    return pa.table(cells | {"found": pa.array([found], pa.list_(pa.struct([(f, kinds[f]) for f in _FOUND])))})


def _histories(hist: np.ndarray, total: np.ndarray, lower: np.ndarray):
    """(distinct histories, counts of counts 1..TOP, sum of ``lower`` over the
    seen n-grams) of n-grams in ascending order of their histories."""
    first = np.flatnonzero(np.concatenate([[True], hist[1:] != hist[:-1]]))
    seen = np.stack([np.add.reduceat((total == r).astype(np.int64), first) for r in range(1, TOP + 1)], axis=1)
    return hist[first], seen, np.add.reduceat(np.where(total > 0, lower, 0.0), first)


def _answer_grams(level: int, bits: int, d: np.ndarray, last: bool):
    """``d`` are the discounts of the level below; numbers are given out unless
    this is the last level."""
    def fn(requests):
        rows = requests.select(["bucket", "chunk", "keys", "count", "word", "hot"]).to_pylist()
        every, total, places, one = _added_up(rows)
        below = np.concatenate([unpack(r["word"], np.uint32) for r in rows])[one].astype(np.int64)
        hist, seen, mass = _histories(every >> U64(bits), total, discounted(below, d))
        bucket, hot = rows[0]["bucket"], rows[0]["hot"]
        of_key = np.searchsorted(hist, every >> U64(bits))
        local = None if last else (np.cumsum(total > 0) - 1).clip(0).astype(np.uint64)
        out = []
        for r, p in zip(rows, places):
            answer = {"level": level, "hot": hot, "chunk": r["chunk"], "bucket": bucket, "a": pack(total[p].astype(np.uint32))}
            if not last:
                answer["b"] = pack_sorted(local[p])
            if not hot:                         # the request's histories, in the order of its keys
                mine = np.unique(of_key[p])
                answer |= {"c": pack(seen[mine].T.astype(np.uint32).ravel()), "d": _pack_repeated(mass[mine])}
            out.append(answer)
        out.append({"level": level, "hot": hot, "bucket": bucket, "n_types": int((total > 0).sum()), "n_tokens": int(total.sum()),
                    "counts": _counts_of_counts(total)})
        if hot:                                 # parts of the histories whose n-grams are spread over all buckets
            out += [{"level": level, "hot": hot, "bucket": bucket, "hist": int(h), "seen": n.tolist(), "lower": float(m)}
                    for h, n, m in zip(hist, seen, mass)]
        return _answer_table(out)
    return fn


def _score(levels: Levels):
    def fn(row, replies):
        import pyarrow as pa
        walk = Walk(row, replies, levels)
        t, c, lower = walk.t, walk.words, levels.lower
        n = len(t.ids)
        plain = np.log10((c + 1) / (lower.n + lower.v + 1))
        return pa.table({
            "_id": pa.array(t.ids, pa.int64(), mask=t.ids == NO_ID), "trained_on": pa.array(t.train),
            "n_tokens": pa.array(t.n_tokens, pa.int64()), "n_known": pa.array(np.bincount(t.doc[c > 0], minlength=n), pa.int64()),
            "train_tokens": pa.array(np.full(n, lower.n), pa.int64()),
            "base_score": pa.array(np.bincount(t.doc, plain, n), pa.float64()),
            "score": pa.array(np.bincount(t.doc, np.log10(walk.prob), n), pa.float64())})
    return fn


_REQUEST = "bucket int, chunk long, keys binary, count binary, word binary"
_KEPT = ["chunk", "ids", "flags", "lengths", "at"]
_FOUND = ["level", "hot", "bucket", "a", "b", "c", "d"]
_TOKENS = "chunk long, ids binary, flags binary, lengths binary, at binary"
_STATE = _TOKENS + ", found array<struct<level:int,hot:boolean,bucket:int,a:binary,b:binary,c:binary,d:binary>>"


def _level_counts(answers: DataFrame) -> tuple[int, int, list[int]]:
    """(types, tokens, counts of counts) over all buckets of a level."""
    own = answers.where("chunk IS NULL AND hist IS NULL")
    sums = [F.sum("n_types"), F.sum("n_tokens"), *[F.sum(F.col("counts")[r]) for r in range(TOP + 1)]]
    types, tokens, *counts = (int(x or 0) for x in own.agg(*sums).first())
    return types, tokens, counts


def _first_numbers(answers: DataFrame, n_buckets: int) -> np.ndarray:
    """First number of every bucket and, after them, of every bucket of hot
    histories: one row per bucket reaches the driver."""
    base = np.zeros(2 * n_buckets + 1, np.int64)
    for r in answers.where("chunk IS NULL AND hist IS NULL").select("bucket", "hot", "n_types").collect():
        base[r["bucket"] + n_buckets * bool(r["hot"]) + 1] = r["n_types"]
    return np.cumsum(base)[:-1]


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                chunk_bytes: int = CHUNK_BYTES, order: int = 2) -> DataFrame:
    """Log10 probabilities of whole texts under a Katz backoff model of
    ``order`` (the longest n-gram, 1 at least), learnt from the rows for which
    ``train`` holds.

    Tokens are the words, ASCII letters lower-cased, and one end per text.
    Returns one row per input row: ``id_col`` (long), trained_on, n_tokens,
    n_known (tokens seen in training), train_tokens, base_score (add-one
    unigrams: the sum of log10((c + 1) / (N + V + 1))) and score.  NULL and
    empty texts are the end alone; identifiers may be NULL or repeated, every
    row is scored; without training rows every token is the unknown word.  An
    empty table gives an empty result, and other columns are not read.  Words
    are told apart by 64-bit hashes; at most 2^64 keys of a history (an n-gram
    seen in training, below the highest level) and a word."""
    if order < 1:
        raise ValueError("order is 1 at least")
    model = _Counted(docs, train, id_col, text_col, chunk_bytes, order)
    if order == 1:
        state = model.state(1)
        rows = per_chunk(model.tables.read(state), None, _score(model.levels), _SCORED)
    else:
        state = model.state(order - 1)
        rows = model.tables.read(state)
        answers = model.count_grams(rows, order)
        rows = per_chunk(rows, answers.where("chunk IS NOT NULL"), _score(model.levels), _SCORED)
    return rows.withColumnRenamed("_id", id_col)


_SCORED = ("_id long, trained_on boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class _Counted:
    """Counts the levels in turn; ``levels`` is what is known so far."""

    def __init__(self, docs: DataFrame, train: Column, id_col: str, text_col: str, chunk_bytes: int, order: int):
        self.docs, self.train, self.id_col, self.text_col = docs, train, id_col, text_col
        self.chunk_bytes, self.order = chunk_bytes, order
        self.levels = self.n_histories = None

    def state(self, level: int) -> str:
        """Stored rows of the chunks with their answers up to a level, bucketed
        by chunk; what the levels below stored is deleted."""
        with temporary(self.docs.sparkSession):
            below = self.tokens() if level == 1 else self.state(level - 1)
            rows = self.tables.read(below)
            answers = self.count_words(rows) if level == 1 else self.count_grams(rows, level)
            made = per_chunk(rows.drop("types"), answers.where("chunk IS NOT NULL"), _taken_up, _STATE)
            table = self.tables.write(made, f"level{level}")
        self.tables.drop(below)
        return table

    def tokens(self) -> str:
        spark = self.docs.sparkSession
        parts = shuffle_partitions(spark)
        with temporary(spark):
            chunks = chunk_table(self.docs, self.id_col, self.text_col, flag=self.train, chunk_bytes=self.chunk_bytes)
            total, n_chunks = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("chunk")).first()
            self.n_buckets = buckets_for(total, BUCKET_BYTES, parts)
            self.tables = Bucketed(spark, "chunk", max(1, min(parts, n_chunks), n_chunks // TASK_CHUNKS))
            rows = per_chunk(chunks, None, _tokenized, _TOKENS + ", types binary")
            return self.tables.write(rows.repartition(self.tables.buckets, "chunk"), "tokens")

    def count_words(self, rows: DataFrame) -> DataFrame:
        asked = per_chunk(rows, None, _ask_words(self.n_buckets), _REQUEST)
        answers = stored(asked.groupBy("bucket").applyInArrow(_answer_words, _ANSWER), "grams1")
        n_types, n_tokens, counts = _level_counts(answers)
        self.levels = Levels(self.n_buckets, n_tokens / HOT_SHARE, Unigrams(n_tokens, n_types, counts),
                             _first_numbers(answers, self.n_buckets), self.docs.where(self.train).count())
        self.n_histories = n_types + 1
        return answers

    def count_grams(self, rows: DataFrame, level: int) -> DataFrame:
        levels = self.levels
        if self.n_histories << levels.bits > 1 << 64:
            raise ValueError(f"too many histories of {level - 1} words for 64-bit keys")
        asked = per_chunk(rows, None, _ask_grams(levels), _REQUEST + ", hot boolean")
        answers = stored(asked.groupBy("bucket", "hot").applyInArrow(
            _answer_grams(level, levels.bits, levels.discounts[level - 1], level == self.order), _ANSWER), f"grams{level}")
        self.n_histories, _, counts = _level_counts(answers)
        # at most HOT_SHARE histories and the start
        self.levels = levels = copy(levels)
        levels.hot = levels.hot | {level: {r["hist"]: (list(r)[1:-1], r["lower"]) for r in answers.where("hist IS NOT NULL").groupBy("hist").agg(
            *[F.sum(F.col("seen")[k]).alias(f"n{k}") for k in range(TOP)], F.sum("lower").alias("lower")).collect()}}
        levels.discounts = levels.discounts | {level: discounts(counts)}
        if level < self.order:
            levels.base = levels.base | {level: _first_numbers(answers, self.n_buckets)}
        return answers

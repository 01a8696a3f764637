"""Language identification by cross-parsing entropy.

Per language, a suffix automaton over a bounded sample of labelled text knows
every substring of the sample.  A text is parsed greedily into the longest
phrases that occur in the sample: the fewer phrases per character, the closer
the language (cross-parsing estimates the cross entropy).

Every label is learned.  The sample is slices of up to ``SAMPLE_DOCS`` documents
per language, ``SAMPLE_CHARS`` characters of them in all, and less where the
languages together would have more than ``TOTAL_CHARS``, so the model's size is
bounded whatever their number.  Letters are written as digits of a base up to
64 (one digit for small alphabets, two for a script of thousands of letters), so
a state with several successors is a short row and all others are one symbol;
parsing restarts every ``BLOCK`` characters, and a task steps through many blocks
at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches

BLOCK = 2048                                    # characters parsed in one go
SAMPLE_DOCS = 128                               # labelled documents per language
SAMPLE_CHARS = 48_000                           # characters per language
TOTAL_CHARS = 1_000_000                         # characters of all languages together
WIDEST = 64                                     # digits of the symbols' base
BROADCAST_LABELS = 100_000
SPARE = 8                                       # times the wanted documents that are ranked
BATCH_CHARS = 2_000_000
UNKNOWN = "und"


def training_sample(docs: DataFrame, n_docs: int, sample_chars: int, total_chars: int, id_col: str, text_col: str,
                    lang_col: str) -> dict[str, list[str]]:
    """A slice of each of up to ``n_docs`` documents of every label, those with
    the smallest hash of the identifier; a slice begins at a place that the hash
    gives.  The driver gets one count per label, and no more than
    ``total_chars`` characters (or one per document and label, if that is more)."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("_l"), F.xxhash64(F.col(id_col), F.lit(11)).alias("_h"), F.col(text_col).alias("_t"))
    counts = labelled.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    n_langs = counts.count()
    if not n_langs:
        return {}
    if n_langs <= BROADCAST_LABELS:             # beyond, a shuffle join
        counts = F.broadcast(counts)
    chars = max(1, min(sample_chars, total_chars // n_langs))
    size = F.ceil(F.lit(chars) / F.least(F.lit(n_docs), F.col("_n")))
    # most rows are out by their hash alone, so few are ranked, whatever the size
    near = (F.col("_h") / F.lit(2.0 ** 64) + 0.5) * F.col("_n") <= SPARE * n_docs
    start = 1 + F.pmod(F.xxhash64("_h"), F.greatest(F.length("_t") - size + 1, F.lit(1)))
    slices = labelled.where(F.length("_t") > 0).join(counts, "_l").where(near).select(
        "_l", "_h", F.substring("_t", start.cast("int"), size.cast("int")).alias("_t"))
    place = F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_t"))
    out: dict[str, list[str]] = {}
    for r in slices.withColumn("_k", place).where(F.col("_k") <= n_docs).orderBy("_l", "_k").collect():
        out.setdefault(r["_l"], []).append(r["_t"])
    return out


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Code points to symbols: 0 for anything but letters, 1.. for the letters
    that the samples hold, the last symbol for all other letters; symbols as
    ``digits`` digits of base ``width``."""

    def __init__(self, samples: dict[str, str]):
        seen = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
        self.size = len(seen) + 2
        self.digits = 1
        while WIDEST ** self.digits < self.size:
            self.digits += 1
        self.width = 2
        while self.width ** self.digits < self.size:
            self.width += 1
        lut = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                lut[cp] = self.size - 1
        for i, c in enumerate(seen):
            lut[ord(c)] = i + 1
        self.lut = lut

    def symbols(self, text: str) -> np.ndarray:
        """Digits of a text's symbols, ``digits`` per character."""
        v = self.lut[normalised(text)]
        places = [v // self.width ** k % self.width for k in range(self.digits - 1, -1, -1)]
        return np.stack(places, axis=1).astype(np.int8).ravel()


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of every state of the automaton that accepts every substring
    of ``symbols``; state 0 is the empty string."""
    n = len(symbols)
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    assert len(nxt) <= 2 * n + 2
    return nxt


class Model:
    """Automata of the learned languages, in order of their labels, as flat
    arrays: a state with one successor has its symbol (``only``) and that state
    (``after``); a state with more has a row of ``rows``, from ``row`` on.  After
    the states of a language comes one without successors, which stands between
    phrases: any symbol begins one there."""

    def __init__(self, texts: dict[str, list[str]]):
        joined = {k: "\n".join(texts[k]) for k in sorted(texts) if any(c.isalpha() for t in texts[k] for c in t)}
        self.langs = list(joined)
        self.alphabet = Alphabet(joined)
        w = self.alphabet.width
        only, after, row, rows = [], [], [], [np.full((1, w), -1, np.int32)]    # row 0: no successor
        restart, between, at, n_rows = [], [], 0, 1
        for lang in self.langs:
            nxt = suffix_automaton(self.alphabet.symbols(joined[lang]))
            n = len(nxt)
            o, a, r = np.full(n + 1, -1, np.int8), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int64)
            branching = [s for s in range(n) if len(nxt[s]) > 1]
            table = np.full((len(branching), w), -1, np.int32)
            for k, s in enumerate(branching):
                r[s] = (n_rows + k) * w
                for c, to in nxt[s].items():
                    table[k, c] = at + to
            for s in range(n):
                if len(nxt[s]) == 1:
                    (o[s], to), = nxt[s].items()
                    a[s] = at + to
            begin = np.full(w, at + n, np.int32)                # a symbol unknown to the root is a phrase of its own
            for c, to in nxt[0].items():
                begin[c] = at + to
            only.append(o), after.append(a), row.append(r), rows.append(table), restart.append(begin), between.append(at + n)
            at, n_rows = at + n + 1, n_rows + len(branching)
        empty = [np.zeros(0, np.int32)]
        self.only, self.after, self.row = (np.concatenate(x or empty) for x in (only, after, row))
        self.rows = np.concatenate(rows).ravel()
        self.restart = np.array(restart, np.int32).reshape(len(self.langs), w)
        self.between = np.array(between, np.int32)

    def phrase_counts(self, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of every block (rows of digits) under every language."""
        n, langs = len(lengths), len(self.langs)
        order = np.argsort(-lengths, kind="stable")
        columns = np.ascontiguousarray(blocks[order].T)
        alive = np.searchsorted(-lengths[order], -np.arange(columns.shape[0]), side="left")     # blocks longer than k
        state = np.repeat(self.between[:, None], n, axis=1)
        count = np.zeros((langs, n), np.int32)
        for k in range(columns.shape[0]):
            m = alive[k]
            c = columns[k, :m]
            s = state[:, :m]
            to = self.rows.take(self.row.take(s) + c)
            np.copyto(to, self.after.take(s), where=self.only.take(s) == c)
            ended = to < 0                      # a phrase begins with this symbol
            count[:, :m] += ended
            np.copyto(to, self.restart[:, c], where=ended)
            state[:, :m] = to
        out = np.empty((langs, n), np.int32)
        out[:, order] = count
        return out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases per language and text, characters per text, whether it has letters)."""
        d = self.alphabet.digits
        syms = [self.alphabet.symbols(t) for t in texts]
        lens = np.array([len(s) // d for s in syms], np.int64)
        letters = np.array([bool(s.any()) for s in syms], bool)
        owner, pieces = [], []
        for i, s in enumerate(syms):
            if letters[i]:
                for lo in range(0, len(s), BLOCK * d):
                    owner.append(i)
                    pieces.append(s[lo:lo + BLOCK * d])
        total = np.zeros((len(self.langs), len(texts)), np.int64)
        if pieces and self.langs:
            size = np.array([len(p) for p in pieces], np.int64)
            blocks = np.zeros((len(pieces), int(size.max())), np.int8)
            for r, p in enumerate(pieces):
                blocks[r, :len(p)] = p
            counts = self.phrase_counts(blocks, size)
            for j in range(len(self.langs)):
                total[j] = np.bincount(owner, counts[j], len(texts)).astype(np.int64)
        return total, lens, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score and phrases per character of every text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        labels, scores, rates = [], [], []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) < BATCH_CHARS):
                chars += len(texts[hi])
                hi += 1
            total, n, known = self.phrases(texts[lo:hi])
            inverse = 1.0 / np.maximum(total, 1)
            labels += [self.langs[b] if k else UNKNOWN for b, k in zip(total.argmin(axis=0), known)]   # ties: the first label
            scores.append(np.where(known, inverse.max(axis=0) / inverse.sum(axis=0), 0.0))
            rates.append(np.where(known, total.min(axis=0) / np.maximum(n, 1), 0.0))
            lo = hi
        return labels, np.concatenate([*scores, np.zeros(0)]), np.concatenate([*rates, np.zeros(0)])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> Model:
    """Automata of all labels, from slices of at most ``sample_docs`` labelled
    documents and ``sample_chars`` characters of each, and about ``total_chars``
    characters of all languages together."""
    return Model(training_sample(docs, sample_docs, sample_chars, total_chars, id_col, text_col, lang_col))


def _predict(bc):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for rb in batches:
            for lo in range(0, rb.num_rows, 1024):
                part = rb.slice(lo, 1024)
                label, score, rate = bc.value.predict(pc.fill_null(part.column("_t"), "").to_pylist())
                cols = [part.column(i) for i in range(rb.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(label, pa.string()), pa.array(score), pa.array(rate)],
                                                 names=[*rb.schema.names[:-1], "lang_pred", "score", "phrases_per_char"])
    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` with lang_pred, score and
    phrases_per_char.

    score is the winner's share of the languages' inverse phrase counts, in
    (0, 1].  A NULL text, one without letters, or an empty model gives ``und``
    and score 0.  Ties go to the label that sorts first.  Only the text decides;
    repeated rows get equal results, and an empty table an empty result."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    bc = spark.sparkContext.broadcast(model)    # bounded by the training sample
    src = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_t"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != "_t")
    out = src.mapInArrow(_predict(bc), f"{fields}lang_pred string, score double, phrases_per_char double")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "phrases_per_char")


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not ``und``, with all their
    columns, whatever they are called.  Only the text goes to Python and only
    the label comes back."""
    small_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(model)        # bounded by the training sample

    @F.arrow_udf("string")
    def label(text):
        import pyarrow as pa
        import pyarrow.compute as pc
        found = []
        for lo in range(0, len(text), 1024):
            found += bc.value.predict(pc.fill_null(text.slice(lo, 1024), "").to_pylist())[0]
        return pa.array(found, pa.string())
    return docs.where(label(F.col(f"`{text_col}`")) != UNKNOWN)

"""Token counts by the whole-token shortcut.

For a word-end BPE vocabulary (``tokenizers`` file whose model marks a word's
last piece with a suffix) it is proved once, before the job, which vocabulary
strings are one token when encoded alone: the tokenizer itself encodes every
string that ends a word, and those with one id remain.  The proof is one set,
bounded by the vocabulary, that the job broadcasts.

In the job a text is split at ASCII spaces and line feeds.  Normalisation,
pre-tokenisation and merging never reach across those, so a text's count is
the sum of its units' counts.  A unit's pre-tokens that are whole tokens count
one each; only the others are merged, many at a time, by the library, and its
counts are kept in a bounded cache.

A unit takes the shortcut only if every character in it behaves as the shortcut
assumes.  That is asked of the tokenizer, character by character, when one is
met first: its lower case, and whether it is a letter, a digit, another sign or
white space.  Other units (combining marks, characters whose lower case or class
differs, strings of added tokens) are encoded by the library as they stand.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "word_bpe_49k.json"
CACHE_UNITS = 300_000                           # counts kept per Python worker
CACHED_LENGTH = 64                              # longer units are counted each time
MERGE_CHARS = 20_000                            # joined pre-tokens per call of the library

#: fixed values: the pre-tokeniser's pattern that the shortcut reproduces, and the endings in it
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

_COUNTERS: dict[str | None, "Counter"] = {}


def vocabulary_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers
        return public_tokenizers.path(VOCABULARY)
    return path


def load(path: str | None):
    """The library's tokenizer without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path(path))
    t.no_truncation()
    t.no_padding()
    return t


def word_suffix(tokenizer) -> str:
    """The mark of a word's last piece; ValueError if the shortcut does not hold
    for the tokenizer's kind."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    steps = (json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}).get("pretokenizers", [])
    if not suffix or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"].get("Regex") != PATTERN:
        raise ValueError("the whole-token shortcut needs a BPE vocabulary that marks the ends of words")
    return suffix


def _letters_to_bytes() -> dict[str, int]:
    """Byte of every character of the byte-level alphabet: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def whole_tokens(path: str | None = None) -> frozenset[str]:
    """The vocabulary strings that the tokenizer gives one token when they are
    encoded alone."""
    t = load(path)
    suffix, alphabet = word_suffix(t), _letters_to_bytes()
    strings = []
    for piece in t.get_vocab(with_added_tokens=False):
        if not piece.endswith(suffix) or not set(piece[:-len(suffix)]) <= alphabet.keys():
            continue
        try:
            strings.append(bytes(alphabet[c] for c in piece[:-len(suffix)]).decode())
        except UnicodeDecodeError:              # a part of a character: no text encodes to it alone
            continue
    proved = []
    for lo in range(0, len(strings), 4096):
        part = strings[lo:lo + 4096]
        proved += [s for s, e in zip(part, t.encode_batch(part, add_special_tokens=False)) if s and len(e.ids) == 1]
    return frozenset(proved)


class Counter:
    """Token counts of texts as the tokenizer at ``path`` gives them; ``whole``
    are its whole tokens."""

    def __init__(self, path: str | None, whole: frozenset[str]):
        self.t = load(path)
        suffix = word_suffix(self.t)
        self.whole = whole
        self.added = [a.content for a in self.t.get_added_tokens_decoder().values()]
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith(suffix)]] = True
        self.units: dict[str, int] = {"": 0}
        self.merged: dict[str, int] = {}
        self.kinds: dict[str, set[str]] = {k: set() for k in ("letter", "digit", "sign", "space")}
        self.known: set[str] = set()            # characters that have been asked for
        self.odd: set[str] = set()              # those that do not take the shortcut
        self.pattern: re.Pattern | None = None

    def _lower_kind(self, c: str) -> str | None:
        """The kind of the lower-case character ``c``; None if the tokenizer does
        not treat it as a character by itself."""
        if unicodedata.category(c)[0] == "M" or self.t.normalizer.normalize_str(c) != c:
            return None
        text = "a" + c + c
        found = [text[a:b] for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(text)]
        for kind, split in (("letter", [text]), ("digit", ["a", c, c]), ("sign", ["a", c + c]), ("space", ["a"])):
            if found == split:
                return kind
        return None

    def _learn_characters(self, new: set[str]) -> None:
        for c in new:
            low = c.lower()
            # marks and Hangul letters may join the character before; a sigma's lower case depends on its place
            simple = unicodedata.category(c)[0] != "M" and not 0x1100 <= ord(c) < 0x1200 and c != "Σ"
            kinds = [self._lower_kind(x) for x in low] if simple and self.t.normalizer.normalize_str(c) == low else [None]
            if None in kinds or "space" in kinds:
                self.odd.add(c)
            else:
                for x, kind in zip(low, kinds):
                    self.kinds[kind].add(x)
        self.known |= new
        runs = [f"[{''.join(map(re.escape, sorted(self.kinds[k])))}]{many}"
                for k, many in (("letter", "+"), ("digit", ""), ("sign", "+")) if self.kinds[k]]
        self.pattern = re.compile("|".join([*map(re.escape, ENDINGS), *runs]))

    def _by_library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.t.encode_batch(texts, add_special_tokens=False)]

    def _merge(self, pre_tokens: list[str]) -> dict[str, int]:
        """Counts of pre-tokens that are no whole tokens, encoded joined by
        spaces and taken apart after every token that ends a word."""
        out: dict[str, int] = {}
        lo = 0
        while lo < len(pre_tokens):
            hi, size = lo, 0
            while hi < len(pre_tokens) and (size < MERGE_CHARS or hi == lo):
                size += len(pre_tokens[hi]) + 1
                hi += 1
            part = pre_tokens[lo:hi]
            ids = np.array(self.t.encode(" ".join(part), add_special_tokens=False).ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part) and last[-1] == len(ids) - 1:
                out.update(zip(part, np.diff(last, prepend=-1).tolist()))
            else:
                out.update(zip(part, self._by_library(part)))
            lo = hi
        return out

    def _count_units(self, units: list[str]) -> list[int]:
        """Counts of distinct units."""
        new = set().union(*units) - self.known if units else set()
        if new:
            self._learn_characters(new)
        odd = self.odd
        plain, other = [], []
        for u in units:
            if (not odd.isdisjoint(u)) or any(a in u for a in self.added):
                other.append(u)
            else:
                plain.append(u)
        split = list(map(self.pattern.findall, map(str.lower, plain))) if plain else []
        whole, merged = self.whole, self.merged
        rest = set().union(*split) - whole - merged.keys() if split else set()
        long = self._merge(sorted(rest))
        out = dict(zip(other, self._by_library(other))) if other else {}
        for u, pre in zip(plain, split):
            out[u] = sum(1 if p in whole else merged[p] if p in merged else long[p] for p in pre)
        if len(merged) + len(long) > CACHE_UNITS:
            merged.clear()
        merged.update((p, n) for p, n in long.items() if len(p) <= CACHED_LENGTH)
        return [out[u] for u in units]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of every text."""
        units = self.units
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(units) > CACHE_UNITS:
            units.clear()
            units[""] = 0
        new = list(set().union(*split) - units.keys()) if split else []
        passing = {}
        for u, n in zip(new, self._count_units(new)):
            (units if len(u) <= CACHED_LENGTH else passing)[u] = n
        if passing:
            return [sum(units[u] if u in units else passing[u] for u in s) for s in split]
        return [sum(map(units.__getitem__, s)) for s in split]


def counter(path: str | None, whole: frozenset[str]) -> Counter:
    """The worker's counter for a tokenizer file (the default vocabulary if None)."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def _count(path: str | None, whole):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        own = counter(path, whole.value)
        for rb in batches:
            for lo in range(0, rb.num_rows, 512):
                part = rb.slice(lo, 512)
                texts = pc.fill_null(part.column("_t"), "")
                counts = own.count(texts.to_pylist())
                yield pa.record_batch({
                    "_id": part.column("_id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64())})
    return run


def count_tokens(docs: DataFrame, limit: int | None = None, tokenizer: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes (UTF-8), n_tokens and,
    with a ``limit``, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor has
    (the public word-end vocabulary if None); another kind of vocabulary raises
    ValueError.  The counts are the library's for the whole text without added
    special tokens, truncation or padding; a special token's string inside a
    text counts as that token.  NULL text counts as empty: 0 bytes, 0 tokens.
    Identifiers may be NULL or repeated, every row has its count; other columns
    are not read, and an empty table gives an empty result.  Memory in a task is
    bounded by the cache and its longest text."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    small_batches(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))       # at most the vocabulary
    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(_count(tokenizer, whole), f"_id {kind}, n_bytes long, n_tokens long")
    out = out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
    return out if limit is None else out.withColumn("over_limit", F.col("n_tokens") > limit)

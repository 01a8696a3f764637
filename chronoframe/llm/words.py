"""Vectorised word splitting and hashing of UTF-8 buffers (numpy, inside tasks).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D within one
document.  Its 64-bit hash is a polynomial of randomised byte values modulo
2^64 through a final mixing step, taken from prefix sums over the buffer, so
no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)          # lower-cases ASCII A-Z
FOLD[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}
BLOCK = 1 << 19                                 # bytes hashed at a time


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 4 * BLOCK:
            _POW[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a string array; NULL counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per document the index of its
    first word (one more entry than documents)."""
    word = ~SPACES[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    cuts = off[(off > 0) & (off < len(data))]   # a document's edge also ends a word
    start[cuts] = word[cuts]
    end[cuts - 1] = word[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = False) -> np.ndarray:
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        lo = s[i]
        j = max(i + 1, int(np.searchsorted(e, lo + BLOCK, side="right")))
        part = data[lo:e[j - 1]]
        if fold:
            part = FOLD[part]
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * _powers(_BASE, n), out=total[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = (total[b] - total[a]) * _powers(_INV, n)[a]
        i = j
    return mix(out)


def hashed_words(texts: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, per document the index of its first word) of an array."""
    data, off = buffer_of(texts)
    s, e, first = word_spans(data, off)
    return word_hashes(data, s, e, fold), first


_GRAM = U64(0xD6E8FEB86659FD93)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``n`` consecutive words (the runs
    that cross a document's edge are included; callers drop them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out = out * _GRAM + h[k:k + m]
    return mix(out)


def run_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two adjoining (or overlapping) runs from the hashes of both."""
    return mix(left * _GRAM + right)


def doc_of_word(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """Compress an array of fixed-width integers, byte planes apart."""
    import zstandard
    a = np.ascontiguousarray(a)
    if a.size == 0:
        return b""
    planes = a.view(np.uint8).reshape(a.size, a.itemsize).T
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard
    dtype = np.dtype(dtype)
    if not b:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Compress ascending uint64 values as differences."""
    d = a.copy()
    d[1:] -= a[:-1]
    return pack(d)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)

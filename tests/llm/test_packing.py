import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from chronoframe.llm import packing


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(plain, text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def check(plain, docs, out, length=1024):
    """Every document's ids are whole, every sequence gapless and in bounds."""
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    for doc_id in {i for i, _ in texts}:
        want = []
        for i, t in texts:
            if i == doc_id:
                ids = ids_of(plain, t)
                first = (len(ids) - 1) % length + 1
                edges = [0, *range(first, len(ids) + 1, length)]
                want += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[doc_id]) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return bins


def test_round_trip(messy, documents, plain):
    for docs in (messy, documents):
        out = packing.pack_documents(docs).collect()
        bins = check(plain, docs, out)
        total = sum(r.length for r in out)
        assert len(bins) <= 1.05 * total / 1024 + 2


def test_further_capacities(documents, plain):
    out = packing.pack_documents(documents, max_documents=2, max_cost=1024 * 1024, rule="dot").collect()
    bins = check(plain, documents, out)
    assert max(map(len, bins.values())) == 2
    with pytest.raises(ValueError):
        packing.pack_documents(documents, max_cost=10)


def test_units_encode_like_whole_texts(plain):
    random.seed(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", " ", "\x1c", ".", "é", "1", "<|endoftext|>", "'s", "'", "\r\n", "​", "漢", "😀",
             "\x85", " x", " ,", "　", "word", " word"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    for enc in (packing.Encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS)),
                packing.Encoder(public_tokenizers.path(packing.VOCABULARY))):
        got = enc.encode(texts)
        want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert got == want


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(5)
    cap, w = np.array([100.0, 6, 4000]), np.array([1, 0.1, 0.1])
    size = np.sort(rng.integers(1, 60, 200))[::-1].astype(float)
    demand = np.stack([size, np.ones(200), size ** 2], axis=1)
    for rule in ("norm", "dot"):
        rooms, want = [], []
        for d in demand:
            best = None
            for b, room in enumerate(rooms):
                if (room >= d).all():
                    s = (room / cap - d / cap) ** 2 @ w if rule == "norm" else -((room / cap) * (d / cap)) @ w
                    if best is None or s < best[0] - 1e-15:
                        best = (s, b)
            if best is None:
                rooms.append(cap - d)
                want.append(len(rooms) - 1)
            else:
                rooms[best[1]] = rooms[best[1]] - d
                want.append(best[1])
        got = packing.vector_best_fit(demand, cap, w, rule)
        assert (np.bincount(got, size) <= 100).all() and (np.bincount(got) <= 6).all() and (np.bincount(got, size ** 2) <= 4000).all()
        assert got.tolist() == want


def test_empty(nothing):
    assert packing.pack_documents(nothing).collect() == []

import collections
import math
import zlib

import pytest
from llm_paths import SMALL, data
from pyspark.sql import functions as F

from chronoframe.llm import katz, queries


class Brute:
    def __init__(self, texts):
        self.c1, self.c2, self.ch = collections.Counter(), collections.Counter(), collections.Counter()
        self.after = collections.defaultdict(list)
        for w in texts:
            h = ["start", *w[:-1]]
            self.c1.update(w)
            self.c2.update(zip(h, w))
            self.ch.update(h)
        for (h, w), c in self.c2.items():
            self.after[h].append((w, c))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.d1, self.d2 = (katz.discounts([sum(v == r for v in c.values()) for r in range(1, 7)]) for c in (self.c1, self.c2))
        freed = sum(c * (1 - self.d1[c]) for c in self.c1.values() if c <= 5)
        self.total = self.n if freed > 0 else self.n + 1
        self.unknown = (freed if freed > 0 else 1) / self.total

    def cut(self, c, d):
        return c * (d[c] if c <= 5 else 1)

    def p1(self, w):
        return self.cut(self.c1[w], self.d1) / self.total if self.c1[w] else self.unknown

    def history(self, h):
        freed = sum(c * (1 - self.d2[c]) for _, c in self.after[h] if c <= 5)
        total = self.ch[h] if freed > 0 else self.ch[h] + 1
        return total, (freed if freed > 0 else 1) / total / (1 - sum(self.p1(w) for w, _ in self.after[h]))

    def p2(self, h, w):
        if not self.ch[h]:
            return self.p1(w)
        total, alpha = self.history(h)
        c = self.c2[h, w]
        return self.cut(c, self.d2) / total if c else alpha * self.p1(w)


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def trained(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 != 2


def test_against_brute_force(messy, documents):
    for docs in (messy, documents.limit(60)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
        got = katz.score_texts(docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3), train, chunk_bytes=50_000)
        m = Brute([tokens(t) for i, t in rows if trained(i)])
        want = []
        memo = {}
        for i, t in rows:
            w = tokens(t)
            for pair in zip(["start", *w[:-1]], w):
                if pair not in memo:
                    memo[pair] = math.log10(m.p2(*pair))
            want.append((i, trained(i), len(w), sum(m.c1[x] > 0 for x in w), m.n,
                         sum(math.log10((m.c1[x] + 1) / (m.n + m.v + 1)) for x in w), sum(memo[p] for p in zip(["start", *w[:-1]], w))))
        key = lambda r: (str(r[0]), r[2], round(r[6], 4))
        for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5]
            assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one(documents):
    m = Brute([tokens(r.text) for r in documents.limit(40).collect()])
    for h in ["start", *list(m.c1)[:12]]:
        if m.ch[h]:
            assert sum(m.p2(h, w) for w in m.c1) + m.history(h)[1] * m.unknown == pytest.approx(1, abs=1e-9)


def test_discounts():
    assert katz.discounts([0] * 6).tolist() == [1.0] * 6
    d = katz.discounts([1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in d[1:])
    freed = sum(n * r * (1 - d[r]) for r, n in enumerate([1000, 400, 220, 140, 100], 1))
    assert freed == pytest.approx(1000)         # Good-Turing's mass of the unseen


def test_edges(messy, nothing):
    never = katz.score_texts(messy, F.lit(False)).collect()
    assert {r.score for r in never} == {0.0} and {r.n_known for r in never} == {0}
    assert katz.score_texts(nothing, F.lit(True)).collect() == []


class BruteN:
    """The model of any order by its definition, on tuples of words."""

    def __init__(self, texts, order):
        self.c, self.h = collections.Counter(), collections.Counter()
        self.after = collections.defaultdict(dict)
        for w in texts:
            w = ["start", *w]
            for i in range(1, len(w)):
                for k in range(1, min(order, i + 1) + 1):
                    self.c[tuple(w[i - k + 1:i + 1])] += 1
                    if k > 1:
                        self.h[tuple(w[i - k + 1:i])] += 1
        for g, c in self.c.items():
            self.after[g[:-1]][g[-1]] = c
        self.d = {k: katz.discounts([sum(c == r and len(g) == k for g, c in self.c.items()) for r in range(1, 7)]) for k in range(1, order + 1)}
        self.n = sum(self.after[()].values())
        self.memo = {}

    def cut(self, c, k):
        return c * (self.d[k][c] if c <= 5 else 1)

    def history(self, h):
        if h not in self.memo:
            freed = sum(c * (1 - self.d[len(h) + 1][c]) for c in self.after[h].values() if c <= 5)
            n = self.h[h] if h else self.n
            total = n if freed > 0 else n + 1
            left = (freed if freed > 0 else 1) / total
            self.memo[h] = total, left, left / (1 - sum(self.p(h[1:], w) for w in self.after[h])) if h else left
        return self.memo[h]

    def p(self, h, w):
        if h and not self.h[h]:
            return self.p(h[1:], w)
        total, _, alpha = self.history(h)
        c = self.c[(*h, w)]
        return self.cut(c, len(h) + 1) / total if c else alpha * self.p(h[1:], w) if h else alpha


@pytest.mark.parametrize("order", [1, 3, 4])
def test_orders_against_brute_force(messy, documents, order):
    for docs in (messy, documents.limit(60)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
        got = katz.score_texts(docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3), train,
                               chunk_bytes=50_000, order=order)
        m = BruteN([tokens(t) for i, t in rows if trained(i)], order)
        want, memo = [], {}
        for i, t in rows:
            w = ["start", *tokens(t)]
            grams = [tuple(w[max(0, k - order + 1):k + 1]) for k in range(1, len(w))]
            for g in grams:
                if g not in memo:
                    memo[g] = math.log10(m.p(g[:-1], g[-1]))
            want.append((i, trained(i), len(grams), sum(memo[g] for g in grams)))
        key = lambda r: (str(r[0]), r[2], round(r[3], 4))
        have = [(r.doc_id, r.trained_on, r.n_tokens, r.score) for r in got.collect()]
        for a, b in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-9)


def test_the_query_uses_trigrams(spark):
    """A word that only its two predecessors tell apart is likelier than by one."""
    rows = [(i, "x m one" if i % 2 else "y m two") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two, three = ({r.doc_id: r.score for r in katz.score_texts(docs, F.lit(True), order=k).collect()} for k in (2, 3))
    assert all(three[i] > two[i] + 0.25 for i in two)
    got = {r.doc_id: r.score for r in queries.op3_katz_scoring(spark, SMALL).collect()}
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    want = {r.doc_id: r.score for r in katz.score_texts(spark.read.parquet(data("documents")), train, order=3).collect()}
    assert got == pytest.approx(want)

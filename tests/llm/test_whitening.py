import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_paths import DATA

from chronoframe.llm import whitening
from chronoframe.llm.queries import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, whitened string, component string, n string"


def reference(rows, k=32):
    """(id, x) pairs in Python integers -> n, S, eigenvalues, vectors, trace."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    cov = np.array([[float(a) for a in r] for r in (z.T.dot(z))]) / float(n) ** 3
    value, vector = np.linalg.eigh(cov)
    return n, z, value[::-1][:k], vector[:, ::-1][:, :k], np.trace(cov)


def check(rows, out, k=32):
    n, z, value, vector, trace = reference(rows, k)
    away = sorted(sum(int(v) ** 2 for v in r) for r in z)
    got = {}
    for r in out:
        got.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert sorted(d for _, d in got) == sorted(set(away)) or sorted(d for _, d in got) == away
    zf = z.astype(float) / n
    want = zf @ vector / np.sqrt(value)
    for i, (vid, _) in enumerate(rows):
        own = got[vid, sum(int(v) ** 2 for v in z[i])]
        assert sorted(own) == list(range(1, len(value) + 1))
        for c, r in own.items():
            assert r.n == n and r.identity_error < 1e-8
            assert abs(abs(r.whitened) - abs(want[i, c - 1])) < 1e-6
            assert abs(r.explained - value[c - 1] / trace) < 1e-9


def test_query_against_dense(spark):
    out = op12_embedding_whitening(spark, DATA)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = out.collect()
    assert len(got) == 32 * len(rows)
    check(rows, got)
    # one sign per component: the whitened columns' covariance is the identity
    w = np.zeros((len(rows), 32))
    place = {v: i for i, (v, _) in enumerate(rows)}
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(w.T @ w / len(rows) - np.eye(32)).max() < 1e-8


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 5), st.integers(1, 40), st.integers(0, 2 ** 32))
def test_sliced_products(n, d, bits, seed):
    y = np.random.default_rng(seed).integers(0, 2 ** bits, (n, d))
    width = max(1, int(y.max()).bit_length())
    got = whitening.sliced_products(whitening.bit_planes(y, width))
    o = y.astype(object)
    assert got[-1] == o.sum(axis=0).tolist()
    full = o.T.dot(o)
    assert got[:-1] == [full[i, i:].tolist() for i in range(d)]
    assert all(whitening.whole(whitening.limbs(v)) == v for r in got for v in r)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    good += [(7, good[7][1]), (None, [0.5, 0.25, -1.0, 3.0])]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 0.0, 0.0]),
           (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1e22, 0.0, 0.0, 0.0]), (906, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "w", "c", "n") for i, v in good + bad], SCHEMA).repartition(5)
    out = whitening.whiten(df).collect()
    assert {r.vec_id for r in out} == {i for i, _ in good}
    assert len(out) == 4 * len(good)
    check(good, out)


def test_wide_ranges_stay_exact(spark):
    rows = [(i, [float((-1) ** i * 2 ** (i % 45)), float(i), 1.0]) for i in range(120)]
    df = spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA)
    out = whitening.whiten(df, components=2).collect()
    _, z, *_ = reference(rows)
    want = {i: sum(int(v) ** 2 for v in r) for (i, _), r in zip(rows, z)}
    for r in out:
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 2 ** 63 else None)
    assert any(r.deviation is None for r in out)


def test_no_variance_and_nothing(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], "", "", "") for i in range(5)], SCHEMA)
    assert whitening.whiten(same).collect() == []
    out = whitening.whiten(same.limit(0))
    assert out.collect() == [] and out.columns[0] == "vec_id"
    line = spark.createDataFrame([(i, [i / 64, 5.0], "", "", "") for i in range(9)], SCHEMA)
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    a, b = (whitening.fit(df.repartition(p)) for p in (1, 7))
    assert a.sums == b.sums and a.n == b.n and np.array_equal(a.value, b.value)

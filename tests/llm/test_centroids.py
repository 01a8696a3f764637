import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_paths import DATA

from chronoframe.llm import centroids
from chronoframe.llm.queries import op13_centroid_clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string, block string, kind string"


def lloyd(rows, k, rounds, scale=256, prefix="2:"):
    """Plain k-means in Python integers."""
    x = [[math.floor(scale * float(c)) for c in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (
        hashlib.sha256((prefix + ("" if rows[i][0] is None else str(rows[i][0]))).encode()).hexdigest(), rows[i][1]))
    c = [x[i] for i in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [nearest(v)[1] for v in x]
        for j in range(len(c)):
            own = [x[i] for i in range(len(x)) if at[i] == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    final = [nearest(v) for v in x]
    inertia = {j: sum(d for d, i in final if i == j) for _, j in final}
    total = sum(d for d, _ in final)
    fits = lambda v: v if v < 2 ** 63 else None
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((vid, j, fits(d), fits(inertia[j]), fits(total), sha[j]) for (vid, _), (d, j) in zip(rows, final)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_plain(spark):
    out = op13_centroid_clustering(spark, DATA)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert got(out) == lloyd(rows, 40, 5)


def test_bounds_spare_scans(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(6, 3)) * 5
    rows = [(i, (centre[i % 6] + rng.normal(size=3) * 0.2).tolist()) for i in range(900)]
    df = spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA).repartition(3)
    scans = []
    out = centroids.cluster(df, k=6, rounds=6, dim=3, scans=scans)
    assert got(out) == lloyd(rows, 6, 6)
    assert scans[0] == 900 and sum(scans[3:]) < 0.2 * 900 * len(scans[3:])


def test_odd_vectors_ties_and_copies(spark):
    good = [(i, [float(i % 5), float(i % 3)]) for i in range(60)] + [(3, [3.0, 0.0]), (None, [-1.0, 2.0]), (None, [9.0, 9.0])]
    good += [(100, [1e22, -1e22]), (101, [3e38, 1.0])]
    bad = [(200, None), (201, []), (202, [1.0]), (203, [1.0, None]), (204, [float("nan"), 1.0]), (205, [float("inf"), 1.0]),
           (206, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, "c", "b", "k") for i, v in good + bad], SCHEMA).repartition(4)
    assert got(centroids.cluster(df, k=7, rounds=3, dim=2)) == lloyd(good, 7, 3)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "", "", ""), (2, [1.0, 2.0], "", "", "")], SCHEMA)
    assert got(centroids.cluster(df, k=5, rounds=2, dim=2)) == lloyd([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 5, 2)
    assert got(centroids.cluster(df, k=1, rounds=2, dim=2)) == lloyd([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 1, 2)
    assert centroids.cluster(df.limit(0), dim=2).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 8), st.integers(1, 6), st.sampled_from([4, 40, 10 ** 6, 10 ** 12]))
def test_bounds_never_err(seed, k, rounds, spread):
    """Assignments along a random walk of centroids equal full scans."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread, (60, 3)).astype(float)
    data, kind = centroids.packed(x)
    x = centroids.unpacked(data, kind, 3)
    state = centroids.State(60)
    history = [rng.integers(-spread, spread, (k, 3)).astype(object)]
    for _ in range(rounds):
        centroids.reassign(x, state, history, centroids.displacements(history))
        d = centroids.squared_distances(centroids.to_integers(x), history[-1])
        assert state.cluster.tolist() == d.argmin(axis=1).tolist()
        history.append(history[-1] + rng.integers(-max(1, spread // 20), max(2, spread // 20), (k, 3)).astype(object))


def test_limbs():
    for v in (0, 1, -1, 2 ** 40, -2 ** 200 + 12345, 2 ** 279):
        assert centroids.whole(centroids.limbs(v)) == v

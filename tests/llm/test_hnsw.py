import numpy as np
import pytest

from chronoframe.llm import hnsw, queries

SF = "/root/testdata/sf0.1"


def brute(rows, query_ids, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if q in query_ids:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = near[:k]
    return out


def test_recall_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    got = {}
    for r in queries.op5_hnsw_search(spark, SF).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in [r.vec_id for r in found]
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        for r in found:
            assert r.score == pytest.approx(d[ids == r.vec_id][0], rel=1e-12)
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits += len({r.vec_id for r in found} & set(want))
    assert hits / (10 * len(got)) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (None, [1.0, 2.0]), (8, [2.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]),
            *[(20 + i, [3.0, 3.0]) for i in range(30)]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    index = hnsw.build_index(df, "vec_id", "embedding")
    got = {}
    for r in hnsw.nearest(df, index, "vec_id", "embedding").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, {r[0] for r in rows if r[0] is not None})
    assert set(got) == {q for q, n in want.items() if n}
    for q, near in got.items():
        assert [(v, s) for _, v, s in sorted(near)] == [(i, pytest.approx(d)) for d, i in want[q]]
    empty = df.limit(0)
    none = hnsw.build_index(empty, "vec_id", "embedding")
    assert hnsw.nearest(empty, none, "vec_id", "embedding").collect() == []
    assert hnsw.nearest(df, none, "vec_id", "embedding").collect() == []


def test_graph_search_finds_itself():
    x = np.random.default_rng(1).normal(size=(600, 16))
    g = hnsw.build_graph(x)
    seen = np.zeros(601, np.int64)
    assert all(g.search(x[i], 16, seen)[0] == i for i in range(0, 600, 7))


def recall(found, x, queries, k=10):
    hit = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({r.vec_id for r in found if r.query_id == q} & {int(i) for i in np.lexsort((np.arange(len(x)), d))[:k]})
    return hit / (k * len(queries))


def test_a_third_jittered_around_one_vector(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)) / 4
    x[::3] = x[0] + rng.normal(size=(1000, 16)) * 1e-5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = hnsw.build_index(df, "vec_id", "embedding")
    inside, outside = list(range(0, 3000, 150)), list(range(1, 3000, 150))
    found = hnsw.nearest(df.where(df.vec_id.isin(inside + outside)), index, "vec_id", "embedding").collect()
    assert recall(found, x, inside) >= 0.9 and recall(found, x, outside) >= 0.9


def test_large_finite_components(spark):
    """Distances whose squares overflow end, and are finite."""
    rng = np.random.default_rng(9)
    for size in (1e22, 1e200, 1.5e308):
        x = rng.uniform(-1, 1, size=(300, 4)) * np.where(np.arange(300)[:, None] % 3, 1.0, size)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = hnsw.nearest(df.where("vec_id % 50 = 0"), hnsw.build_index(df, "vec_id", "embedding"), "vec_id", "embedding").collect()
        assert len(got) == 60 and all(r.score >= 0 for r in got)
        for r in got:
            a, b = x[r.query_id] / 2, x[r.vec_id] / 2
            unit = np.abs(a - b).max()
            want = 2 * unit * np.sqrt((((a - b) / unit) ** 2).sum())
            assert r.score == want or abs(r.score - want) <= 1e-12 * want

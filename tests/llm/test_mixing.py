from collections import defaultdict

import pytest
from llm_paths import DATA, words
from pyspark.sql import functions as F

from chronoframe.llm import mixing, queries


def water_fill(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken(spark, messy):
    for docs in (messy, spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = mixing.mix(docs).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
        size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in rows:
            size[r.source] += r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
            assert 0 <= r.taken <= 2 * r.size and r.copies * r.size == r.taken
        want = water_fill(size)
        for r in rows:
            assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source], abs=1e-5)
        for s in size:
            assert abs(taken[s] - want[s]) <= largest[s]


def test_sizes_and_repeatability(messy, nothing):
    got = sorted((str(r.doc_id), r.size, r.copies) for r in mixing.mix(messy).collect())
    assert [g[:2] for g in got] == sorted((str(r.doc_id), len(words(r.text))) for r in messy.collect())
    assert got == sorted((str(r.doc_id), r.size, r.copies) for r in mixing.mix(messy.repartition(7)).collect())
    assert mixing.mix(nothing).collect() == [] and mixing.mixed(nothing).collect() == []


def test_the_mix_holds_whole_rows(messy):
    out = mixing.mixed(messy)
    assert out.columns == messy.columns
    want = defaultdict(int)
    for r in mixing.mix(messy).collect():
        want[r.doc_id] += r.copies
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in want.items() if v}


def test_no_python_in_the_plan(spark):
    plan = queries.op7_source_mixing(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_hot_source_is_spread(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
                                    F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"))
    placed = mixing._copies(docs, None, "doc_id", "text", "source", 1.5, 2.0, (5, 2, 1), 7, False)
    assert placed.where("source = 'hot'").select("_pid").distinct().count() > 1

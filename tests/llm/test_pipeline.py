import sys

import pytest
from llm_paths import SMALL, words
from test_jaccard_join import shingles

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline as cp  # noqa: E402


def test_stages_one_after_another(spark, messy):
    """Each stage against a brute-force reading of its own input."""
    from chronoframe.llm.common import stored
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, seen[-1], SMALL), name)
        assert out.columns == docs.columns
        seen.append(out)
    before, identified, exact, near, mixed = [d.collect() for d in seen]
    assert {r.doc_id for r in identified} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    last = {}
    for r in identified:
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    sets = {r.doc_id: shingles(r.text) for r in exact}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    kept = {r.doc_id for r in near}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and alike(a, b):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert kept == {i for i in sets if find(i) == i}
    assert {r.doc_id for r in mixed} <= kept
    assert all(r in near for r in mixed)
    pieces = cp.STAGES[-1][1](spark, seen[-1], SMALL)
    whole = pieces.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in mixed}
    for name, stage in cp.STAGES[:-1]:           # and on a messy table
        messy = stored(stage(spark, messy, SMALL), name)
    assert all(words(r.text) for r in messy.collect())
    assert cp.STAGES[-1][1](spark, messy, SMALL).count() > 0


def test_run_gives_the_last_stage(spark):
    from chronoframe.llm import common
    known = len(common._TABLES)
    out = cp.run(spark, SMALL)
    # of the first four stages only their results are left, and the pieces of the last one
    assert len(common._TABLES) == known + 5
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 1024


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, nothing, k):
    assert cp.STAGES[k][1](spark, nothing, SMALL).collect() == []

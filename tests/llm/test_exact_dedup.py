import hashlib

import pytest

from chronoframe.llm import exact_dedup as ed


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = max if keep == "largest" else min
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, pick(ids) if ids else None, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, messy, documents, keep):
    for docs in (messy, documents):
        got = ed.exact_dedup(docs, keep=keep).collect()
        want = brute([(r.doc_id, r.text) for r in docs.collect()], keep)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
        by_text = {}
        for r in got:
            by_text.setdefault(r.text_sha256, []).append(r)
        for rows in by_text.values():
            assert [r.doc_id for r in rows if r.kept] == [rows[0].keep_id]


def test_a_hot_text_is_spread_over_partitions(spark):
    rows = [(i, "hot text" if i % 2 else f"t{i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    runs = ed._sorted_runs(docs, "doc_id", "text", "largest", payload=False)
    hot = runs.where("_runs IS NULL AND _size > 1").groupBy("_pid").count().collect()
    assert len(hot) > 1
    got = ed.exact_dedup(docs).where("group_size > 1")
    assert got.select("keep_id", "group_size").distinct().collect() == [(3999, 2000)]
    assert got.where("kept").count() == 1
    assert ed.drop_exact_copies(docs).count() == 2001


def test_whole_rows_come_through(messy, nothing):
    kept = ed.drop_exact_copies(messy)
    assert kept.columns == messy.columns
    rows = [tuple(r) for r in messy.collect()]
    assert all(tuple(r) in rows for r in kept.collect())
    assert kept.count() == len({r.text or "" for r in messy.collect()})
    assert ed.exact_dedup(nothing).collect() == [] and ed.drop_exact_copies(nothing).collect() == []
    with pytest.raises(ValueError):
        ed.exact_dedup(messy, keep="first")

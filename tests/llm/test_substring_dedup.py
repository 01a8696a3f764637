import pytest
from llm_paths import words

from chronoframe.llm import substring_dedup as sd


def brute(rows, w):
    last = max((i for i, _ in rows if i is not None), default=0) + 1
    first = {}
    for i, t in rows:
        x = words(t)
        for k in range(len(x) - w + 1):
            g = tuple(x[k:k + w])
            first[g] = min(first.get(g, last), last if i is None else i)
    out = []
    for i, t in rows:
        x = words(t)
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if first[tuple(x[k:k + w])] < (last if i is None else i):
                gone[k:k + w] = [True] * w
        out.append((i, len(x), sum(gone), " ".join(a for a, b in zip(x, gone) if not b)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,seed", [(13, 8), (13, 3), (5, 8), (30, 4)])
def test_against_brute_force(messy, documents, window, seed):
    for docs in (messy, documents):
        got = sd.substring_dedup(docs, window=window, seed=seed, chunk_bytes=60_000)
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], window)


def test_levels_at_most_double():
    for w in range(2, 200):
        steps = sd.levels(w)
        assert steps[-1] == w and all(a < b <= 2 * a for a, b in zip(steps, steps[1:]))
    assert sd.levels(13) == [7, 13]


def test_stops_when_no_candidate_survives(spark, nothing):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(40)))],
                                 "doc_id long, text string")
    assert {r.n_removed for r in sd.substring_dedup(docs).collect()} == {0}
    assert sd.substring_dedup(nothing).collect() == []
    with pytest.raises(ValueError):
        sd.substring_dedup(docs, window=1)

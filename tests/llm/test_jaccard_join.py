import itertools
import random

import numpy as np
from llm_paths import words

from chronoframe.llm import jaccard_join as jj
from chronoframe.llm.components import connected_components


def shingles(text, n=5):
    x = words(text)
    return {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if len(x) >= n else ({tuple(x)} if x else set())


def brute(rows, t=0.8):
    sets = [shingles(x) for _, x in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    return sorted([(rows[i][0], least[find(i)], links[i], len(members[find(i)])) for i in range(len(rows))], key=str)


def near_copies(spark, n=260):
    """A large group of near copies of one text, smaller ones, and loners."""
    rng = random.Random(4)
    make = lambda k: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(k)]
    rows, base = [], make(150)
    for i in range(n):
        x = list(base)
        for _ in range(rng.randrange(4)):
            x[rng.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(x)))
    for g in range(30):
        x = make(60)
        for k in range(3):
            y = list(x)
            y[rng.randrange(60)] = f"z{k}"
            rows.append((1000 + 10 * g + k, " ".join(y)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_against_brute_force(spark, messy, documents):
    for docs in (messy, documents, near_copies(spark)):
        got = jj.jaccard_join(docs).select("doc_id", "class_id", "n_links", "class_size")
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_row_of_each_class_stays(messy, nothing):
    out = jj.jaccard_join(messy)
    n_classes = out.where("kept").count()
    kept = jj.drop_near_copies(messy)
    assert kept.columns == messy.columns and kept.count() == n_classes
    assert sum(1 for r in kept.collect() if r.doc_id == -5) == 1       # the smallest of its class
    assert jj.jaccard_join(nothing).collect() == [] and jj.drop_near_copies(nothing).collect() == []


def test_runs_reach_the_target_recall():
    assert 1 - (1 - 0.8 ** jj.DEPTH) ** jj.runs_for(0.8, 0.999) >= 0.999


def test_min_tokens_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = jj.min_tokens(x[:2500]), jj.min_tokens(x[500:])
    assert abs((a == b).mean() - 2000 / 3000) < 0.15


def test_shared_counts_dense_and_pairwise_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 120).astype(np.uint64)) for _ in range(12)]
    a, b = np.triu_indices(12, 1)
    want = [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(a, b)]
    assert jj.shared_counts(sets, a, b).tolist() == want
    assert jj.shared_counts(sets, a[:5], b[:5]).tolist() == want[:5]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)]

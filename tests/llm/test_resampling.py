import numpy as np
import pyarrow as pa
from llm_paths import DATA
from pyspark.sql import functions as F

from chronoframe.llm import queries, resampling as rs


def test_selection_keeps_clean_and_drops_junk(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = queries.op6_importance_resampling(spark, DATA)
    n, k = out.count(), out.where("selected").count()
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    assert k == int(rs.target_share(labels, good) * n + 0.5)
    assert [r["rank"] for r in out.orderBy("rank").collect()] == list(range(1, n + 1))
    rate = {r["quality"]: r["s"] for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("double")).alias("s")).collect()}
    assert rate[1] > 0.75 and rate[0] < 0.35


def test_weights_against_direct_sums(spark, documents):
    ids = documents.where("doc_id % 3 = 0").select("doc_id")
    ratio = rs.fit(documents, ids, n_buckets=4096, orders=(1, 2))
    rows = documents.select("doc_id", "text").collect()
    doc, bucket = rs.gram_buckets(pa.array([r.text for r in rows]), 4096, (1, 2))
    good = np.array([r.doc_id % 3 == 0 for r in rows])
    raw, target = np.bincount(bucket, minlength=4096), np.bincount(bucket[good[doc]], minlength=4096)
    more = rs.PSEUDO * target.sum() / raw.sum()
    want = np.log((target + more) / (target.sum() + more * 4096)) - np.log((raw + rs.PSEUDO) / (raw.sum() + rs.PSEUDO * 4096))
    assert np.allclose(ratio, want)
    got = {r.doc_id: r for r in rs.resample(documents, ratio, 0.5, orders=(1, 2)).collect()}
    for i, r in enumerate(rows):
        assert abs(got[r.doc_id].log_weight - want[bucket[doc == i]].sum()) < 1e-6
        assert got[r.doc_id].n_grams == (doc == i).sum()


def test_draws_follow_the_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("text"))
    _, (bx,) = rs.gram_buckets(pa.array(["x"]), 64, (1,))
    ratio = np.zeros(64)
    ratio[bx] = np.log(4.0)
    out = rs.resample(docs, ratio, 0.05).where("selected")
    share = out.where("doc_id % 2 = 0").count() / out.count()
    assert 0.68 < share < 0.9                    # expected 0.8, less a little for lack of replacement


def test_edges(messy, nothing):
    labels = messy.where("doc_id < 4")
    ratio = rs.fit(messy, labels)
    out = rs.resample(messy, ratio, 0.5).collect()
    assert len(out) == messy.count() and sum(r.selected for r in out) == (messy.count() + 1) // 2
    assert {r.log_weight for r in out if r.n_grams == 0} == {0.0}
    assert rs.fit(messy, labels.limit(0)).tolist() == [0.0] * rs.BUCKETS
    assert rs.resample(nothing, ratio, 0.5).collect() == []
    assert rs.fit(nothing, nothing).sum() == 0


def _fixed(raw, target, n):
    more = rs.TARGET_PSEUDO
    other = more * raw.sum() / target.sum()
    return np.log((target + more) / (target.sum() + more * n)) - np.log((raw + other) / (raw.sum() + other * n))


def test_every_target_row_counts(spark):
    n = 30_000
    word = F.concat(F.lit("w"), (F.crc32(F.col("id").cast("string")) % 50).cast("string"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), word.alias("text"))
    ids = docs.where("doc_id < 25000").select("doc_id")
    rows = docs.collect()
    doc, bucket = rs.gram_buckets(pa.array([r.text for r in rows]), 256, (1,))
    good = np.array([r.doc_id < 25000 for r in rows])
    raw, target = np.bincount(bucket, minlength=256), np.bincount(bucket[good[doc]], minlength=256)
    assert target.sum() == 25_000
    assert np.allclose(rs.fit(docs, ids.union(ids), n_buckets=256, target_pseudo=rs.TARGET_PSEUDO), _fixed(raw, target, 256))


def test_a_chance_zero_in_a_small_target_weighs_little(spark):
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when((F.col("id") >= 200) & (F.col("id") < 1200), "plain odd")
                                      .otherwise("plain words").alias("text"))
    _, (odd,) = rs.gram_buckets(pa.array(["odd"]), 4096, (1,))
    ratio = rs.fit(docs, docs.where("doc_id < 100").select("doc_id"), n_buckets=4096, target_pseudo=rs.TARGET_PSEUDO)
    assert -0.3 < ratio[odd] < 0                 # two occurrences were to be expected


def test_the_query_takes_pairs_of_words(spark):
    out = {r.doc_id: r.n_grams for r in queries.op6_importance_resampling(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    doc, _ = rs.gram_buckets(pa.array([r.text for r in rows]), 64, (1, 2))
    assert [out[r.doc_id] for r in rows] == np.bincount(doc, minlength=len(rows)).tolist()

"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from . import (centroids, exact_dedup, hnsw, html_text, jaccard_join, katz, langid, mixing, packing,
               resampling, substring_dedup, token_count, whitening)
from .common import table


def remainder(divisor: int) -> Column:
    """crc32 of the identifier as text; NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return jaccard_join.jaccard_join(docs, n=5, threshold=0.8, recall=0.99999).select(
        "doc_id", "class_id", "n_links", "class_size")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    held = remainder(5) == 0
    model = langid.train(docs.where(~held))
    return langid.identify(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def op3_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    scored = katz.score_texts(docs, train=remainder(7) != 2, order=3)
    return scored.select("doc_id", (~F.col("trained_on")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]), length=1024)


def op5_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    index = hnsw.build_index(vectors, "vec_id", "embedding", k=10)
    return hnsw.nearest(vectors.where("vec_id % 100 = 0"), index, "vec_id", "embedding", k=10)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    ratio = resampling.fit(docs, labels.where(good), orders=(1, 2), target_pseudo=resampling.TARGET_PSEUDO)
    return resampling.resample(docs, ratio, resampling.target_share(labels, good), orders=(1, 2))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents", ["doc_id", "text"]), keep="largest")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    cut = substring_dedup.substring_dedup(docs, window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents", ["doc_id", "text"]), limit=2048)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), components=32)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return centroids.cluster(vectors, k=40, rounds=5, dim=64, scale=256, prefix="2:")


_QUERIES = [op1_ngram_jaccard_join, op2_language_id, op3_katz_scoring, op4_best_fit_packing, op5_hnsw_search,
            op6_importance_resampling, op7_source_mixing, op8_html_extraction, op9_exact_dedup, op10_substring_dedup,
            op11_token_counts, op12_embedding_whitening, op13_centroid_clustering]


def _ready(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: _ready(fn) for fn in _QUERIES}


#: documents as lists of words
WORD_LISTS = r"""t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""

OP1_SQL = "WITH RECURSIVE " + WORD_LISTS + """,
s AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 4) AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS k FROM t)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 5 * common >= 4 * (i.c + j.c - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT x AS doc_id, min(y) AS class_id, (SELECT count(*) FROM l WHERE l.x = r.x) AS n_links, count(*) AS class_size
FROM r GROUP BY x
"""

OP10_SQL = "WITH " + WORD_LISTS + """,
v AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY list_slice(w, k, k + 12)) AS first
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM t)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 12)) AS k FROM v WHERE first < doc_id),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.k) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM t) x
         ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.k = x.k GROUP BY x.doc_id)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: prefix sums of the copies that each document expects, in units of 2^-30
MIX_CTES = r"""
sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 2.0::DOUBLE * source_size AS most,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sources),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER
    (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
turning AS (SELECT arg_min(level, most / w) AS level FROM levels WHERE level * w <= most),
targets AS (SELECT source, source_size, round(least(most, coalesce(t.level * w, most)), 6) AS target,
  ('0x' || substr(md5('7:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT % 1073741824 AS start
  FROM levels, turning t),
steps AS (SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 1073741824)::BIGINT ELSE 0 END AS step
  FROM targets),
summed AS (SELECT d.*, t.source_size, t.target, t.step,
  t.start + t.step * row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS upto
  FROM sized d JOIN steps t ON d.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, (upto >> 30) - ((upto - step) >> 30) AS copies FROM summed)
"""

OP7_SQL = "WITH " + MIX_CTES.format(docs="documents") + """
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed
"""

#: k-means unrolled over its rounds; c<r> are the centroids of round r, a<r> the assignment to them
def _kmeans_sql(k: int, rounds: int, dim: int) -> str:
    assign = """a{r} AS MATERIALIZED (SELECT vec_id, x, k, d FROM (
  SELECT vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
    row_number() OVER (PARTITION BY vec_id ORDER BY d, c.k) AS place FROM kept v, c{r} c) WHERE place = 1)"""
    update = """c{n} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY dim) AS x FROM (
    SELECT k, dim, sum(x[dim])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, generate_series(1, {dim}) g(dim) GROUP BY k, dim)
  GROUP BY k) m ON m.k = c.k)"""
    steps = [assign.format(r=0)]
    for r in range(rounds):
        steps += [update.format(n=r + 1, r=r, dim=dim), assign.format(r=r + 1)]
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h)::INTEGER - 1 AS k, x
  FROM (SELECT x, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k})),
""" + ",\n".join(steps) + f"""
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k
"""


OP13_SQL = _kmeans_sql(40, 5, 64)


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op7_source_mixing": OP7_SQL, "op9_exact_dedup": OP9_SQL,
            "op10_substring_dedup": OP10_SQL, "op13_centroid_clustering": OP13_SQL}

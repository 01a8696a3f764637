"""Quality selection by importance resampling.

Two bags of hashed word n-grams are counted, one over target text and one over
all raw text.  A document's log importance weight is the sum over its n-grams
of the log ratio of their smoothed probabilities in the two bags; adding
Gumbel noise and taking the largest keys draws documents without replacement
in proportion to their weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from .words import U64, gram_hashes, hashed_words, pack, unpack

BUCKETS = 1 << 17                               # hashed n-grams
PSEUDO = 30.0                                   # pseudo-count per bucket in the raw bag
TARGET_PSEUDO = 10.0                            # pseudo-count per bucket in the target bag, where that is fixed


def gram_buckets(texts, n_buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of all word n-grams of a string array; ASCII letters
    are lower-cased."""
    words, first = hashed_words(texts, fold=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    docs, buckets = [], []
    for n in orders:
        g = gram_hashes(words, n)
        inside = doc[:len(g)] == doc[n - 1:n - 1 + len(g)]
        docs.append(doc[:len(g)][inside])
        buckets.append((((g[inside] >> U64(32)) * U64(n_buckets)) >> U64(32)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


def _count(n_buckets: int, orders: tuple[int, ...]):
    def run(batches):
        import pyarrow as pa
        total = np.zeros(n_buckets, np.int64)
        for rb in batches:
            for lo in range(0, rb.num_rows, 512):
                _, bucket = gram_buckets(rb.slice(lo, 512).column("_t"), n_buckets, orders)
                total += np.bincount(bucket, minlength=n_buckets)
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.record_batch({"bucket": pa.array(seen, pa.int64()), "n": pa.array(total[seen])})
    return run


def _packed(n_buckets: int, orders: tuple[int, ...]):
    def run(batches):
        import pyarrow as pa
        for rb in batches:
            for lo in range(0, rb.num_rows, 512):
                part = rb.slice(lo, 512)
                doc, bucket = gram_buckets(part.column("_t"), n_buckets, orders)
                key = np.sort(doc * n_buckets + bucket)
                cuts = np.searchsorted(key, np.arange(part.num_rows + 1) * n_buckets)
                key %= n_buckets
                packed = [pack(np.diff(key[i:j], prepend=0).astype(np.uint32)) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(packed, pa.binary())], names=["_id", "_grams"])
    return run


def _count_packed(n_buckets: int):
    def run(batches):
        import pyarrow as pa
        total = np.zeros(n_buckets, np.int64)
        for rb in batches:
            for grams in rb.column("_grams").to_pylist():
                np.add.at(total, np.cumsum(unpack(grams, np.uint32), dtype=np.int64), 1)
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.record_batch({"bucket": pa.array(seen, pa.int64()), "n": pa.array(total[seen])})
    return run


def _bag(counts: DataFrame, n_buckets: int) -> np.ndarray:
    """Sums per bucket; only this table, of fixed size, reaches the driver."""
    counted = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    bag = np.zeros(n_buckets)
    bag[counted["bucket"]] = counted["n"]
    return bag


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS,
        orders: tuple[int, ...] = (1,), pseudo: float = PSEUDO, target_pseudo: float | None = None) -> np.ndarray:
    """Log ratio of target and raw probability per bucket.

    Raw counts cover all documents, the target all those whose identifier is in
    ``target_ids`` (column ``id_col``).  Every bucket gets ``target_pseudo``
    more target counts, and as many raw counts as the bags' sizes make of them:
    an n-gram that few target words are to be expected of weighs next to
    nothing, however small the target's share is.  Without ``target_pseudo``
    it is the raw bag that gets ``pseudo`` more counts, and the target as many
    as the bags' sizes make of those."""
    ids = target_ids.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL")
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind, counts = src.schema["_id"].dataType.simpleString(), "bucket long, n long"
    raw = _bag(src.select("_t").mapInArrow(_count(n_buckets, orders), counts), n_buckets)
    # the labels are a table of any size; the packed n-grams are dealt, not the texts
    grams = src.where("_id IS NOT NULL").mapInArrow(_packed(n_buckets, orders), f"_id {kind}, _grams binary")
    good = grams.join(ids.hint("merge"), "_id", "left_semi").select("_grams")
    target = _bag(good.mapInArrow(_count_packed(n_buckets), counts), n_buckets)
    if not target.any():                        # no target text: every document weighs the same
        return np.zeros(n_buckets)
    share = target.sum() / raw.sum()
    if target_pseudo is not None:
        pseudo = target_pseudo / share
    scaled = pseudo * share
    return (np.log((target + scaled) / (target.sum() + scaled * n_buckets))
            - np.log((raw + pseudo) / (raw.sum() + pseudo * n_buckets)))


def _weigh(bc, orders: tuple[int, ...]):
    def run(batches):
        import pyarrow as pa
        ratio = bc.value
        for rb in batches:
            for lo in range(0, rb.num_rows, 512):
                part = rb.slice(lo, 512)
                doc, bucket = gram_buckets(part.column("_t"), len(ratio), orders)
                n = np.bincount(doc, minlength=part.num_rows)
                total = np.bincount(doc, ratio[bucket], part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(n.astype(np.int64)), pa.array(total)], names=["_id", "n_grams", "log_weight"])
    return run


def resample(docs: DataFrame, ratio: np.ndarray, fraction: float, id_col: str = "doc_id", text_col: str = "text",
             orders: tuple[int, ...] = (1,), seed: int = 17) -> DataFrame:
    """Draw ``fraction`` of the documents (rounded) without replacement.

    Returns one row per input row: ``id_col``, n_grams, log_weight, gumbel_key,
    rank (from 1, by falling key), selected.  The noise is drawn from a hash of
    the identifier and ``seed``, so reruns agree; equal keys rank by
    identifier.  NULL and empty texts have no n-grams and log weight 0.  An
    empty table gives an empty result; other columns are not read."""
    bc = docs.sparkSession.sparkContext.broadcast(ratio)      # n_buckets numbers
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    weighed = src.mapInArrow(_weigh(bc, orders), f"_id {kind}, n_grams long, log_weight double")
    u = (F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    keyed = keyed.withColumn("_down", -F.col("gumbel_key"))
    ranked = dense_index(keyed, ["_down", "_id"], idx="_rank")
    n = ranked.count()
    k = int(fraction * n + 0.5)
    return ranked.select(F.col("_id").alias(id_col), "n_grams", "log_weight", "gumbel_key",
                         (F.col("_rank") + 1).cast("long").alias("rank"), (F.col("_rank") < k).alias("selected"))


def target_share(labels: DataFrame, good) -> float:
    """Share of the labelled rows that satisfy ``good``."""
    row = labels.agg(F.avg(F.coalesce(good, F.lit(False)).cast("double"))).first()
    return float(row[0] or 0.0)

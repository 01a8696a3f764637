"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Targets: the sources, in code-point order with NULL last, weigh 5, 2, 1,
repeating, and share a fixed part of the corpus' size.  A target stops at
``cap`` times its source's size, and the excess is shared out again by weight:
target = min(cap * size, level * weight), with the level that uses up the
total.  Sampling: within a source, every document expects target / size copies;
the running sum of the expected copies, plus one offset per source, yields a
copy at every integer it crosses.  Expected copies are whole multiples of
2^-30, so the sums are exact and reruns agree; documents run in order of size,
which spreads the copies evenly over long and short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shuffle_partitions, stored

UNIT = 1 << 30
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from per-source sizes (source, source_size).

    The level is found in closed form: with the sources ordered by
    cap * size / weight, those before the turning point are at their cap."""
    w_col = F.lit(weights[-1])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("_r", rank % len(weights))
    for i, w in enumerate(weights[:-1]):
        w_col = F.when(F.col("_r") == i, F.lit(w)).otherwise(w_col)
    s = s.withColumn("_w", w_col.cast("double")).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    s = s.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    found = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("a"),
                                                   F.col("_level").alias("b")))).over(everything)["b"]
    target = F.round(F.least(F.col("_cap"), F.coalesce(found * F.col("_w"), F.col("_cap"))), 6)
    return s.select("source", "source_size", target.alias("target"))


def _offset(seed: int) -> Column:
    """One pseudo-random offset in [0, UNIT) per source."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % UNIT


def _copies(docs: DataFrame, size: Column | None, id_col: str, text_col: str, source_col: str, share: float, cap: float,
            weights: tuple[int, ...], seed: int, payload: bool) -> DataFrame:
    size = n_words(F.col(f"`{text_col}`")) if size is None else size
    cols = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size")]
    if payload:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    n = shuffle_partitions(docs.sparkSession)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("_id").asc_nulls_first()]
    # a hot source is spread over many ranges; the stored table fixes the places
    placed = stored(docs.select(*cols).repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_row")), "mix-order")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    # one row per range and source; numbers of rows follow each other within a range
    parts = placed.groupBy(key.alias("_key"), "_pid").agg(
        F.first("source").alias("source"), F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    per_source = parts.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"))
    targets = source_targets(per_source.drop("_key"), share, cap, weights)
    step = F.when(F.col("source_size") > 0,
                  F.round(F.col("target") / F.col("source_size") * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
    targets = targets.select(key.alias("_key"), "source_size", "target", step.alias("_step"), _offset(seed).alias("_offset"))
    # every document of a source expects the same copies, so the sum before a
    # range is its rows times the step
    earlier = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.join(targets, "_key").select(
        "_key", "_pid", "_first", "source_size", "target", "_step",
        (F.col("_offset") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)) * F.col("_step")).alias("_start")), "mix-starts")
    out = placed.withColumn("_key", key).join(parts, ["_pid", "_key"])
    upto = F.col("_start") + (F.col("_row") - F.col("_first") + 1) * F.col("_step")
    copies = F.shiftright(upto, 30) - F.shiftright(upto - F.col("_step"), 30)
    return out.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", share: float = 1.5, cap: float = 2.0,
        weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """Copies of every document in the mix.

    Returns one row per input row: ``id_col``, size, source, source_size,
    target (of the source), copies, taken = copies * size.  NULL text has size
    0; a NULL source is a source of its own and comes last; documents of size 0
    take 0 words; a source without words has target 0.  ``id_col`` may be NULL
    or repeated: rows are sampled one by one (fully equal rows are
    interchangeable).  An empty table gives an empty result, and other columns
    are not read."""
    out = _copies(docs, size, id_col, text_col, source_col, share, cap, weights, seed, payload=False)
    return out.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", share: float = 1.5, cap: float = 2.0,
          weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as
    :func:`mix` takes it."""
    out = _copies(docs, size, id_col, text_col, source_col, share, cap, weights, seed, payload=True)
    return out.select("_doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")

"""Ordering primitives for ordered (time-series / longitudinal) tables.

Spark rows carry no order, so every ordered operator works on an explicit
dense 0-based ``idx`` per series (or per subject).  Three building blocks keep
one long series -- or one hot subject holding a third of all rows -- from
falling into a single task:

* ``dense_index``   range-partition + per-partition offsets (no global
                    ``Window.orderBy`` and so no ``SinglePartition`` exchange).
* ``halo_window``   bounded frames (lag/lead/centred frames) evaluated per
                    block ``idx div B``; rows near a block edge are duplicated
                    into the neighbouring block and dropped afterwards.
* ``blocked_scan``  unbounded frames (cumulative sums, forward / backward
                    fill) as a local scan per block plus a carry computed on
                    the tiny per-block summary table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import block_size, cut_lineage

BLK = "_blk"
HALO = "_halo"


def _cols(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def dense_index(df: DataFrame, order_by, keys=(), idx: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based position ``idx`` in ``order_by`` order (per ``keys``).

    ``order_by`` must be a total order (include a tie-breaker column).  The
    table is range partitioned on ``keys + order_by`` and sorted within the
    partitions, so a hot key is spread over several partitions.

    * no keys: position = rows of earlier partitions (a per-partition table,
      broadcast) + position in the partition;
    * keys: the rows of a key are contiguous inside a partition, so a row's
      position is its distance from the key's first row there plus the key's
      rows in earlier partitions; both come from a summary with one row per
      (partition, key), joined back.  No row leaves the JVM.
    """
    keys, order_by = _cols(keys), _cols(order_by)
    if any(not isinstance(k, str) for k in keys):
        raise ValueError("keys must be column names")
    order_cols = keys + order_by
    if num_partitions:
        ranged = df.repartitionByRange(num_partitions, *order_cols)
    else:
        ranged = df.repartitionByRange(*order_cols)
    ranged = ranged.sortWithinPartitions(*order_cols)
    pid = F.spark_partition_id()
    pos = ranged.select(
        "*",
        pid.alias("_pid"),
        (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("_loc"),
    )
    # positions are only stable while the partitioning is: cut the lineage here
    pos = cut_lineage(pos)
    if not keys:
        stats = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        # one row per partition: bounded by the partition count
        offsets = F.broadcast(stats.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")))
        out = pos.join(offsets, "_pid")
        return out.select(*[F.col(c) for c in df.columns], (F.col("_loc") + F.col("_off")).alias(idx))
    return _keyed_index(pos, df, keys, idx)


def _keyed_index(pos: DataFrame, df: DataFrame, keys: list, idx: str) -> DataFrame:
    parts = pos.groupBy("_pid", *keys).agg(F.min("_loc").alias("_start"), F.count(F.lit(1)).alias("_n"))
    # a hot key has one row per partition here; a NULL key is a key like any other
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                         (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"))
    same = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return pos.join(parts, same).select(*[F.col(c) for c in df.columns], (F.col("_loc") + F.col("_shift")).alias(idx))


def add_blocks(df: DataFrame, idx: str = "idx", size: int | None = None,
               before: int = 0, after: int = 0) -> DataFrame:
    """Assign ``_blk = idx div size``; duplicate rows needed by the previous /
    next block (within ``after`` / ``before`` rows of the edge) flagged ``_halo``."""
    size = block_size(df.sparkSession, size)
    if before > size or after > size:
        raise ValueError(f"halo ({before}, {after}) larger than block size {size}")
    blk = F.floor(F.col(idx) / F.lit(size)).cast("long")
    pos = F.col(idx) - blk * F.lit(size)
    if before == 0 and after == 0:
        return df.withColumn(BLK, blk).withColumn(HALO, F.lit(False))
    parts = [F.struct(blk.alias(BLK), F.lit(False).alias(HALO))]
    if before > 0:
        parts.append(F.when(pos >= size - before, F.struct((blk + 1).alias(BLK), F.lit(True).alias(HALO))))
    if after > 0:
        parts.append(F.when(pos < after, F.struct((blk - 1).alias(BLK), F.lit(True).alias(HALO))))
    return df.select("*", F.inline(F.array_compact(F.array(*parts))))


def by_block(df: DataFrame, keys: list) -> DataFrame:
    """Partition by (keys, block).  After a join on the keys alone Spark would
    take that partitioning as good enough for a window per block, and a whole
    series would end up in one task."""
    return df.repartition(*[F.col(k) for k in keys], F.col(BLK))


def halo_window(df: DataFrame, exprs: Callable[[Window], dict], idx: str = "idx", keys=(),
                before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Evaluate window expressions whose frame spans at most ``before`` rows back
    and ``after`` rows ahead.  ``exprs(w)`` returns ``{name: column}`` built on
    the block window ``w``; existing columns of the same name are replaced."""
    keys = _cols(keys)
    b = by_block(add_blocks(df, idx, size, before, after), keys)
    w = Window.partitionBy(*keys, BLK).orderBy(idx)
    new = exprs(w)
    sel = [new[c].alias(c) if c in new else F.col(c) for c in df.columns]
    sel += [v.alias(k) for k, v in new.items() if k not in df.columns]
    return b.select(*sel, HALO).where(~F.col(HALO)).drop(HALO)


def lagged(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = (), leads: Sequence[int] = (),
           idx: str = "idx", keys=(), size: int | None = None,
           name: Callable[[str, int], str] | None = None) -> DataFrame:
    """Add ``lag(col, k)`` / ``lead(col, k)`` columns (NULL outside the series)."""
    lags, leads = list(lags), list(leads)
    name = name or (lambda c, k: f"{c}_lag{k}" if k > 0 else f"{c}_lead{-k}")

    def exprs(w):
        out = {}
        for c in cols:
            for k in lags:
                out[name(c, k)] = F.lag(c, k).over(w)
            for k in leads:
                out[name(c, -k)] = F.lead(c, k).over(w)
        return out

    return halo_window(df, exprs, idx, keys, max(lags, default=0), max(leads, default=0), size)


def _block_join(local: DataFrame, summary: DataFrame, keys: list) -> DataFrame:
    # The summary has one row per (key, block).  AQE turns this join into a
    # broadcast join when the materialised summary is under the broadcast
    # threshold, else it is a sort-merge join co-partitioned with the local
    # window output (both hash partitioned on keys + block).
    return local.join(summary, [*keys, BLK], "left")


def blocked_fill(df: DataFrame, cols: Sequence[str], idx: str = "idx", keys=(),
                 direction: str = "forward", size: int | None = None) -> DataFrame:
    """Fill of ``cols`` in ``idx`` order within ``keys``; a fill never crosses
    keys.  ``direction``: 'forward' (carry the last observation), 'backward'
    (carry the next one) or 'both' (forward, then backward for what is left,
    in the same pass: one block window, one summary, one join)."""
    keys = _cols(keys)
    cols = list(cols)
    if not cols:
        return df
    require_dir = direction in ("forward", "backward", "both")
    if not require_dir:
        raise ValueError(f"direction must be forward, backward or both, not {direction!r}")
    fwd, bwd = direction in ("forward", "both"), direction in ("backward", "both")
    b = by_block(add_blocks(df, idx, size), keys)
    w = Window.partitionBy(*keys, BLK).orderBy(idx)
    wf = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wbk = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = []
    aggs = []
    for i, c in enumerate(cols):
        if fwd:
            local.append(F.last(c, ignorenulls=True).over(wf).alias(f"_f{i}"))
            aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"_le{i}"))
        if bwd:
            local.append(F.first(c, ignorenulls=True).over(wbk).alias(f"_b{i}"))
            aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"_fe{i}"))
    summary = b.groupBy(*keys, BLK).agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy(BLK)
    carry = []
    for i in range(len(cols)):
        if fwd:
            carry.append(F.last(f"_le{i}", ignorenulls=True).over(
                wb.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_cf{i}"))
        if bwd:
            carry.append(F.first(f"_fe{i}", ignorenulls=True).over(
                wb.rowsBetween(1, Window.unboundedFollowing)).alias(f"_cb{i}"))
    summary = summary.select(*keys, BLK, *carry)
    loc = b.select(*[F.col(c) for c in df.columns], BLK, *local)
    joined = _block_join(loc, summary, keys)

    def filled(i, c):
        parts = []
        if fwd:
            parts += [F.col(f"_f{i}"), F.col(f"_cf{i}")]
        if bwd:
            parts += [F.col(f"_b{i}"), F.col(f"_cb{i}")]
        return F.coalesce(*parts).alias(c)

    return joined.select(*[filled(cols.index(c), c) if c in cols else F.col(c) for c in df.columns])


def blocked_cumsum(df: DataFrame, cols: Sequence[str], idx: str = "idx", keys=(),
                   size: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Running sum of ``cols`` (NULL counts as 0) in ``idx`` order per ``keys``."""
    keys = _cols(keys)
    cols = list(cols)
    b = by_block(add_blocks(df, idx, size), keys)
    w = Window.partitionBy(*keys, BLK).orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loc = b.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_loc_{i}") for i, c in enumerate(cols)])
    summary = b.groupBy(*keys, BLK).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_tot_{i}") for i, c in enumerate(cols)])
    wb = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, BLK, *[
        F.coalesce(F.sum(f"_tot_{i}").over(wb), F.lit(0)).alias(f"_off_{i}") for i in range(len(cols))])
    joined = _block_join(loc, summary, keys)
    return joined.select(*[F.col(c) for c in df.columns], *[
        (F.col(f"_loc_{i}") + F.col(f"_off_{i}")).alias(f"{c}{suffix}") for i, c in enumerate(cols)])


def blocked_suffix_min(df: DataFrame, col: str, idx: str = "idx", keys=(), size: int | None = None,
                       out: str | None = None) -> DataFrame:
    """``min(col)`` over rows ``>= idx`` (per ``keys``): a local suffix
    minimum per block plus the minimum of the later blocks from the summary."""
    keys = _cols(keys)
    out = out or f"{col}_sufmin"
    b = by_block(add_blocks(df, idx, size), keys)
    w = Window.partitionBy(*keys, BLK).orderBy(idx).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    loc = b.select(*[F.col(c) for c in df.columns], BLK, F.min(col).over(w).alias("_lm"))
    summary = b.groupBy(*keys, BLK).agg(F.min(col).alias("_bm"))
    wb = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(1, Window.unboundedFollowing)
    summary = summary.select(*keys, BLK, F.min("_bm").over(wb).alias("_cm"))
    j = _block_join(loc, summary, keys)
    return j.select(*[F.col(c) for c in df.columns], F.least(F.col("_lm"), F.col("_cm")).alias(out))


def series_length(df: DataFrame, keys=()) -> DataFrame:
    keys = _cols(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

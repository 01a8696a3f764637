"""Exact dedup by content sort.

Sampled splitters range-partition the rows by text, each partition is sorted
by Spark's external sorter, and neighbouring rows are compared in full.  The
sort key is (first bytes of the text, 64-bit hash of it, the text, identifier):
equal texts are adjacent, the sampled splitters stay small however long the
texts are, and because the identifier is part of the key a text that fills a
third of the table is spread over several partitions.  A run that crosses a
partition's edge is joined up from one boundary row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, small_batches, stored

PREFIX = 48                                     # characters of the text in the splitters


def _runs(payload: bool, keep_last: bool):
    """mapInArrow pass over a sorted partition; see :func:`_sorted_runs`."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list = []                         # rows of the open run (payload: its keeper alone)
        n_held = 0                              # rows of the open run seen so far
        last_text = first_text = None
        n_runs, first_size, first_keep = 0, 0, None

        def emit(tbl, starts, sizes, segs):
            """Rows of closed runs: ``starts`` are their first rows in ``tbl``."""
            ends = np.append(starts[1:], tbl.num_rows)
            keeper = (ends - 1) if keep_last else starts
            run_of = np.repeat(np.arange(len(starts)), ends - starts)
            keep_id = tbl.column("_id").take(pa.array(keeper)).take(pa.array(run_of))
            kept = np.zeros(tbl.num_rows, bool)
            kept[keeper] = True
            cols = {"_pid": pa.array(np.full(tbl.num_rows, pid, np.int32)), "_seg": pa.array(segs[run_of].astype(np.int32)),
                    "_size": pa.array(sizes[run_of].astype(np.int64)), "_keep": keep_id, "_kept": pa.array(kept)}
            for name in tbl.column_names:
                cols[name] = tbl.column(name)
            n = tbl.num_rows
            cols |= {"_first": pa.nulls(n, pa.string()), "_last": pa.nulls(n, pa.string()), "_runs": pa.nulls(n, pa.int64())}
            return pa.table(cols).combine_chunks().to_batches()

        shape = None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            text = rb.column("_t")
            n = rb.num_rows
            rest = pa.Table.from_batches([rb])
            if not payload:                     # a kept row gets its text back from the sort key
                rest = rest.drop_columns(["_t"])
            shape = shape or rest.schema
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = pc.invert(pc.equal(text.slice(1), text.slice(0, n - 1))).to_numpy(zero_copy_only=False)
            head = text[0].as_py()
            if first_text is None:
                first_text = head
            new[0] = last_text is None or head != last_text
            last_text = text[n - 1].as_py()
            at = np.flatnonzero(new)
            if len(at) == 0:                    # the open run goes on through the whole batch
                held.append(rest)
                n_held += n
            else:
                tail = int(at[-1])
                if n_held or tail:
                    tbl = pa.concat_tables([*held, rest.slice(0, tail)])
                    had = sum(x.num_rows for x in held)
                    starts = at[:-1] + had if n_held == 0 else np.concatenate([[0], at[:-1] + had])
                    ends = np.append(starts[1:], tbl.num_rows)
                    sizes = ends - starts
                    if n_held:
                        sizes[0] += n_held - had
                    segs = np.full(len(starts), -1)
                    if n_runs == 0:
                        segs[0], first_size = 0, int(sizes[0])
                        k = (ends[0] - 1) if keep_last else 0
                        first_keep = tbl.column("_id")[int(k)].as_py()
                    n_runs += len(starts)
                    if payload:
                        pick = (ends - 1) if keep_last else starts
                        tbl, starts = tbl.take(pa.array(pick)), np.arange(len(pick))
                    yield from emit(tbl, starts, sizes, segs)
                held, n_held = [rest.slice(tail)], n - tail
            if payload:                         # the keeper stands for the run
                joined = pa.concat_tables(held)
                held = [joined.slice(joined.num_rows - 1 if keep_last else 0, 1)]
        if shape is None:
            return
        tbl = pa.concat_tables(held)
        n_runs += 1
        k = tbl.num_rows - 1 if keep_last else 0
        last_keep = tbl.column("_id")[k].as_py()
        if n_runs == 1:
            first_size, first_keep = n_held, last_keep
        yield from emit(tbl, np.array([0]), np.array([n_held]), np.array([0 if n_runs == 1 else 1]))
        id_type = shape.field("_id").type
        edge = {"_pid": pa.array([pid, pid], pa.int32()), "_seg": pa.array([0, 1], pa.int32()),
                "_size": pa.array([first_size, n_held], pa.int64()), "_keep": pa.array([first_keep, last_keep], id_type),
                "_kept": pa.array([False, False])}
        edge |= {f.name: pa.nulls(2, f.type) for f in shape}
        edge |= {"_first": pa.array([first_text, None], pa.string()), "_last": pa.array([None, last_text], pa.string()),
                 "_runs": pa.array([n_runs, n_runs], pa.int64())}
        yield from pa.table(edge).to_batches()
    return run


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, keep: str, payload: bool) -> DataFrame:
    """One row per document (``payload``: per run of equal texts and partition,
    its keeper with all columns), and two boundary rows per partition, stored."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    last = keep == "largest"
    t = F.coalesce(F.col(text_col), F.lit(""))
    cols = [F.col(id_col).alias("_id"), t.alias("_t")]
    if payload:
        others = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns) if c != text_col]
        cols.append(F.struct(F.col(text_col).isNull().alias("_null"), *others).alias("_row"))
    key = [F.substring("_t", 1, PREFIX), F.xxhash64("_t"), F.col("_t"),
           F.col("_id").asc_nulls_first() if last else F.col("_id").asc_nulls_last()]
    split = [key[0], key[1], key[3]]            # bounded splitters in the same order
    small_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    ordered = docs.select(*cols).repartitionByRange(n, *split).sortWithinPartitions(*key)
    if not payload:
        ordered = ordered.withColumn("_sha", F.sha2("_t", 256))
    fields = [T.StructField("_pid", T.IntegerType()), T.StructField("_seg", T.IntegerType()),
              T.StructField("_size", T.LongType()), T.StructField("_keep", ordered.schema["_id"].dataType),
              T.StructField("_kept", T.BooleanType())]
    fields += [T.StructField(f.name, f.dataType) for f in ordered.schema if payload or f.name != "_t"]
    fields += [T.StructField("_first", T.StringType()), T.StructField("_last", T.StringType()),
               T.StructField("_runs", T.LongType())]
    return stored(ordered.mapInArrow(_runs(payload, last), T.StructType(fields)), "content-sort")


def _joined_up(runs: DataFrame, keep: str) -> DataFrame:
    """(_pid, _seg, _total, _whole, _holds) of the edge runs that continue in a
    neighbouring partition: size and keeper of the whole run, and whether this
    part holds the keeper.  At most two rows per partition."""
    last = keep == "largest"
    edge = runs.where(F.col("_runs").isNotNull())
    by_pid = Window.orderBy("_pid")
    # one row per partition that has rows
    rank = edge.where("_seg = 0").select("_pid", F.row_number().over(by_pid).alias("_k"))
    edge = edge.join(F.broadcast(rank), "_pid")
    left = edge.where("_seg = 1").select((F.col("_k") + 1).alias("_k"), "_last")
    right = edge.where("_seg = 0").select("_k", "_first")
    # the full comparison across the edge
    linked = left.join(right, "_k").select("_k", (F.col("_last") == F.col("_first")).alias("_linked"))
    part = edge.where((F.col("_seg") == 0) | (F.col("_runs") > 1)).select("_pid", "_seg", "_k", "_size", "_keep")
    part = part.join(linked, "_k", "left")
    fresh = F.when((F.col("_seg") == 0) & F.coalesce(F.col("_linked"), F.lit(False)), 0).otherwise(1)
    order = Window.orderBy("_k", "_seg")
    chain = part.withColumn("_chain", F.sum(fresh).over(order))
    whole = Window.partitionBy("_chain")
    place = whole.orderBy(*([F.desc("_k"), F.desc("_seg")] if last else ["_k", "_seg"]))
    out = chain.select(
        "_pid", "_seg", F.sum("_size").over(whole).alias("_total"),
        F.first("_keep").over(place).alias("_whole"),
        (F.row_number().over(place) == 1).alias("_holds"), F.count(F.lit(1)).over(whole).alias("_parts"))
    return out.where("_parts > 1").drop("_parts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Group rows of identical text; of each group the row with the ``keep``
    (``largest`` or ``smallest``) identifier stays.

    Returns one row per input row: ``id_col``, keep_id, group_size, kept,
    text_sha256.  NULL text counts as empty, so NULL and empty texts form one
    group.  A NULL identifier never stays while its group has another one;
    among repeated rows with the same identifier exactly one is kept.  An empty
    table gives an empty result; other columns of ``docs`` are not read."""
    runs = _sorted_runs(docs, id_col, text_col, keep, payload=False)
    rows = runs.where(F.col("_runs").isNull())
    # bounded by two rows per partition
    rows = rows.join(F.broadcast(_joined_up(runs, keep)), ["_pid", "_seg"], "left")
    crosses = F.col("_total").isNotNull()
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(crosses, F.col("_whole")).otherwise(F.col("_keep")).alias("keep_id"),
        F.when(crosses, F.col("_total")).otherwise(F.col("_size")).alias("group_size"),
        (F.col("_kept") & F.coalesce(F.col("_holds"), F.lit(True))).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: str = "largest") -> DataFrame:
    """``docs`` with one row per distinct text (see :func:`exact_dedup`); the
    kept rows come unchanged, with all their columns, out of the same sort."""
    runs = _sorted_runs(docs, id_col, text_col, keep, payload=True)
    rows = runs.where(F.col("_runs").isNull() & F.col("_kept"))
    rows = rows.join(F.broadcast(_joined_up(runs, keep)), ["_pid", "_seg"], "left")
    text = F.when(~F.col("_row._null"), F.col("_t"))
    return rows.where(F.coalesce(F.col("_holds"), F.lit(True))).select(
        *[(text if c == text_col else F.col(f"_row._c{i}")).alias(c) for i, c in enumerate(docs.columns)])

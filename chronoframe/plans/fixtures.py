"""Series and longitudinal tables derived from the given Parquet tables.

Every fixture is a Spark plan over the input tables, so its work grows with
them.  Scans select only the columns they need (pruned at the Parquet reader)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import resample
from ..operators.ordering import dense_index
from ..session import cut_lineage
from ..sources.tables import read_table

HOURLY_VARS = ["click", "error", "purchase", "signup", "view"]


def ts_hourly(spark: SparkSession, sf_dir: str, step_seconds: int = 3600, materialize: bool = True) -> DataFrame:
    """``events``: mean ``value`` per hour and event type, one column per type,
    missing hours added as NULL rows. Columns: idx, t, click .. view.
    Materialised (checkpoint) unless the caller materialises what it derives."""
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    other = ev.where(F.col("event_type").isNotNull() & ~F.col("event_type").isin(HOURLY_VARS)).select("event_type").limit(1).collect()
    if other:                                   # a type without a column would be lost silently
        raise ValueError(f"event type {other[0][0]!r} has no column; known: {HOURLY_VARS}")
    out = resample(ev, "ts", step_seconds, "value", key="event_type", values=HOURLY_VARS)
    return cut_lineage(out) if materialize else out


def ts_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders``: per order date the total price and order count; ``idx`` is
    the dense position of the day (time = row position, as in the reference)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    day = o.groupBy(F.col("o_orderdate").alias("t")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    return cut_lineage(dense_index(day, ["t"], idx="idx"))


def ts_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` x ``customer``: daily total per market segment (long), with
    ``idx`` = dense position of the day within its segment."""
    o = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice", "o_custkey"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    j = o.join(c, o.o_custkey == c.c_custkey)
    day = j.groupBy(F.col("o_orderdate").alias("t"), F.col("c_mktsegment").alias("segment")).agg(
        F.sum("o_totalprice").alias("total"))
    return cut_lineage(dense_index(day, ["t"], keys=["segment"], idx="idx"))


def ld_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudinal view of ``events``: subject ``user_id``, ``visit`` = dense
    position in (ts, event_id) order per subject; ``value`` missing when
    event_id % 7 = 0 and ``event_type`` missing when event_id % 11 = 0 (the
    fixture's deterministic gaps; no rows are removed); ``k`` from ``props``."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    ev = ev.select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))
    return cut_lineage(dense_index(ev, ["ts", "event_id"], keys=["user_id"], idx="visit"))


def ld_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n_chars"))


def ml_docs(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """``documents`` with their labels; ``how="left"`` keeps those without."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars", "lang", "source"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return d.join(lab, "doc_id", how)


def wide_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])

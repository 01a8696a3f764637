"""Ordering primitives: dense index, halo windows and blocked scans agree with
pandas for any block size, and never plan a single-partition exchange."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import ordering as o
from fixture_paths import SF001


@pytest.fixture(scope="module")
def events(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    return ev.withColumn("v", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))


@pytest.fixture(scope="module")
def keyed(events):
    return o.dense_index(events, ["ts", "event_id"], keys=["user_id"], idx="visit").cache()


def test_dense_index_keyed(events, keyed):
    ref = events.toPandas().sort_values(["user_id", "ts", "event_id"])
    ref["visit"] = ref.groupby("user_id").cumcount()
    got = keyed.select("event_id", "visit").toPandas().merge(ref[["event_id", "visit"]], on="event_id")
    assert len(got) == len(ref)
    assert (got.visit_x == got.visit_y).all()


def test_dense_index_global(events):
    g = o.dense_index(events, ["ts", "event_id"], idx="i").toPandas().sort_values("i")
    ref = events.toPandas().sort_values(["ts", "event_id"])
    assert g.i.tolist() == list(range(len(ref)))
    assert (g.event_id.to_numpy() == ref.event_id.to_numpy()).all()


@pytest.mark.parametrize("size", [3, 17, 100, 65536])
def test_halo_lag_lead(keyed, size):
    out = o.lagged(keyed, ["v"], lags=[1, 3], leads=[2], idx="visit", keys=["user_id"], size=size)
    got = out.toPandas().sort_values(["user_id", "visit"])
    ref = keyed.toPandas().sort_values(["user_id", "visit"])
    assert len(got) == len(ref)
    for k, c in [(1, "v_lag1"), (3, "v_lag3"), (-2, "v_lead2")]:
        exp = ref.groupby("user_id").v.shift(k).to_numpy(dtype=float)
        assert np.allclose(exp, got[c].to_numpy(dtype=float), equal_nan=True)


def test_halo_larger_than_block_rejected(keyed):
    with pytest.raises(ValueError):
        o.lagged(keyed, ["v"], lags=[5], idx="visit", keys=["user_id"], size=4)


@pytest.mark.parametrize("size", [5, 64, 65536])
def test_blocked_fill_and_cumsum(keyed, size):
    ref = keyed.toPandas().sort_values(["user_id", "visit"])
    f = o.blocked_fill(keyed, ["v"], "visit", ["user_id"], size=size).toPandas().sort_values(["user_id", "visit"])
    assert np.allclose(ref.groupby("user_id").v.ffill().to_numpy(dtype=float), f.v.to_numpy(dtype=float), equal_nan=True)
    b = o.blocked_fill(keyed, ["v"], "visit", ["user_id"], "backward", size).toPandas().sort_values(["user_id", "visit"])
    assert np.allclose(ref.groupby("user_id").v.bfill().to_numpy(dtype=float), b.v.to_numpy(dtype=float), equal_nan=True)
    c = o.blocked_cumsum(keyed, ["v"], "visit", ["user_id"], size=size).toPandas().sort_values(["user_id", "visit"])
    exp = ref.assign(z=ref.v.fillna(0)).groupby("user_id").z.cumsum().to_numpy()
    assert np.allclose(exp, c.v_cum.to_numpy())


def test_fill_never_crosses_subjects(keyed):
    f = o.blocked_fill(keyed, ["v"], "visit", ["user_id"], size=8).toPandas()
    first = keyed.where(F.col("visit") == 0).toPandas().set_index("user_id").v
    got = f[f.visit == 0].set_index("user_id").v
    assert got.isna().equals(first.isna().reindex(got.index))


def _single_partition_inputs(plan_text):
    """For every single-partition exchange, the operator feeding it."""
    lines = [ln.strip(" :+-*") for ln in plan_text.splitlines()]
    out = []
    for i, ln in enumerate(lines):
        if ln.startswith("Exchange SinglePartition"):
            out.append(lines[i + 1] if i + 1 < len(lines) else "")
    return out


def test_no_single_partition_exchange(spark):
    g = spark.range(0, 5000).select(F.col("id").alias("idx"),
                                    F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") * 0.5).alias("v"))
    halo = o.lagged(g, ["v"], lags=[1, 5], leads=[2], idx="idx", size=50)
    text = halo._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "hashpartitioning(_blk" in text
    for p in (o.blocked_fill(g, ["v"], "idx", size=50), o.blocked_cumsum(g, ["v"], "idx", size=50)):
        text = p._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_blk" in text
        # the only single-partition step is the carry over the per-block summary
        feeds = _single_partition_inputs(text)
        assert all("HashAggregate" in f for f in feeds), feeds


def test_plain_window_would_be_single_partition(spark, keyed):
    from pyspark.sql import Window
    w = Window.orderBy("visit")
    text = keyed.select(F.lag("v").over(w))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in text


@pytest.mark.parametrize("size", [4, 65536])
def test_fill_both_directions_one_pass(keyed, size):
    ref = keyed.toPandas().sort_values(["user_id", "visit"])
    exp = ref.groupby("user_id").v.ffill()
    exp = exp.groupby(ref.user_id).bfill().to_numpy(dtype=float)
    got = o.blocked_fill(keyed, ["v"], "visit", ["user_id"], "both", size).toPandas().sort_values(["user_id", "visit"])
    assert np.allclose(exp, got.v.to_numpy(dtype=float), equal_nan=True)


def test_hot_subject_is_split_and_exact(spark, events):
    """One subject holding a third of all rows: the range partitioning spreads
    it over several partitions and the per-subject index and fill stay exact."""
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    idx = o.dense_index(hot, ["ts", "event_id"], keys=["user_id"], idx="visit", num_partitions=8)
    parts = idx.where(F.col("user_id") == -1).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2
    ref = hot.toPandas().sort_values(["user_id", "ts", "event_id"])
    ref["visit"] = ref.groupby("user_id").cumcount()
    got = idx.select("event_id", "visit").toPandas().merge(ref[["event_id", "visit"]], on="event_id")
    assert (got.visit_x == got.visit_y).all()
    f = o.blocked_fill(idx, ["v"], "visit", ["user_id"], size=256)
    blocks = o.add_blocks(idx.where(F.col("user_id") == -1), "visit", 256).select("_blk").distinct().count()
    assert blocks >= 10
    got = f.toPandas().sort_values(["user_id", "visit"])
    exp = ref.groupby("user_id").v.ffill().to_numpy(dtype=float)
    assert np.allclose(exp, got.v.to_numpy(dtype=float), equal_nan=True)


def test_keyed_index_across_arrow_batches(spark, events):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        hot = events.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")))
        got = o.dense_index(hot, ["ts", "event_id"], keys=["user_id"], idx="visit", num_partitions=5) \
            .select("event_id", "visit").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    ref = hot.toPandas().sort_values(["user_id", "ts", "event_id"])
    ref["visit"] = ref.groupby("user_id").cumcount()
    m = got.merge(ref[["event_id", "visit"]], on="event_id")
    assert len(m) == len(ref) and (m.visit_x == m.visit_y).all()

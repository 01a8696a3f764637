"""Streaming carry-forward equals the batch operator on the longitudinal fixture."""
import numpy as np

from chronoframe.operators import impute as im
from chronoframe.plans import fixtures as fx
from chronoframe.streaming.locf import locf_stream
from fixture_paths import SF0001


def test_stream_locf_matches_batch(spark, tmp_path):
    e = fx.ld_events(spark, SF0001).select("user_id", "visit", "value")
    # three arrival waves in visit order, one parquet folder each
    src = tmp_path / "src"
    for i, (lo, hi) in enumerate([(0, 2), (2, 5), (5, 10 ** 9)]):
        e.where((e.visit >= lo) & (e.visit < hi)).write.parquet(str(src / f"wave={i}"))
    stream = (spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    q = (locf_stream(stream, "user_id", "visit", ["value"]).writeStream.format("memory")
         .queryName("locf_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("locf_out").toPandas().sort_values(["user_id", "visit"]).reset_index(drop=True)
    exp = im.locf(e, ["value"], "visit", "user_id").toPandas().sort_values(["user_id", "visit"]).reset_index(drop=True)
    assert len(got) == len(exp)
    assert (got.visit.to_numpy() == exp.visit.to_numpy()).all()
    assert np.allclose(got.value.to_numpy(dtype=float), exp.value.to_numpy(dtype=float), equal_nan=True)

"""Answers that must not depend on the size, the partitioning or the company of a series."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.functions import gram as gm
from chronoframe.operators import diagnostics as dg
from chronoframe.operators import impute as im
from chronoframe.operators import learn as lr
from chronoframe.operators import linear as ln
from chronoframe.operators import ordering as od
from chronoframe.operators import transform as tf
from chronoframe.operators import validate as va


def series(spark, **values):
    rows = [(v, i, float(x)) for v, xs in values.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "variable string, idx long, value double")


def test_keyed_index_keeps_big_keys_apart(spark):
    big = 2 ** 53
    rows = [(k, i, None if i % 5 else big + 1) for i in range(60) for k in (big, big + 1, None)]
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(7)
    out = od.dense_index(df, ["i"], keys=["k"], idx="pos", num_partitions=6)
    assert all(r.pos == r.i for r in out.collect()) and out.select("k").distinct().count() == 3
    assert {r.x for r in out.collect()} == {None, big + 1}
    assert "Python" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_a_series_stays_split_after_a_join(spark, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long = spark.range(20_000).select(F.lit("s").alias("variable"), F.col("id").alias("idx"), F.rand(1).alias("value"))
        mean = long.groupBy("variable").agg(F.avg("value").alias("m"))
        out = od.halo_window(long.join(mean, "variable"), lambda w: {"p": F.lag("value", 1).over(w)}, "idx", ["variable"],
                             before=1, size=500)
        tasks = out.select(F.spark_partition_id().alias("t"), "p").where("p IS NOT NULL").groupBy("t").count().collect()
        assert len(tasks) >= 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_adf_of_a_series_ignores_the_others(spark):
    rng = np.random.default_rng(1)
    walk = rng.normal(size=800)
    walk[1:] += 0.9 * walk[:-1]
    alone = ln.adf(series(spark, a=walk)).first()
    together = {r.variable: r for r in ln.adf(series(spark, a=walk, b=rng.normal(size=12), c=[1.0, 2.0, 3.0])).collect()}
    assert together["a"].used_lag == alone.used_lag and together["a"].adf_stat == pytest.approx(alone.adf_stat, rel=1e-9)
    assert together["b"].adf_stat is not None
    assert together["c"].adf_stat is None and together["c"].stationary is None


def test_missing_values_are_refused(spark):
    x = series(spark, a=np.arange(40.0)).withColumn("value", F.when(F.col("idx") != 7, F.col("value")))
    for run in (lambda: ln.adf(x), lambda: dg.acf(x)):
        with pytest.raises(Exception, match="missing values"):
            run().collect()
    wide = x.select("idx", F.col("value").alias("u"), F.col("idx").cast("double").alias("w"))
    with pytest.raises(Exception, match="missing values"):
        ln.granger(wide, ["u", "w"], maxlag=1).collect()


def test_gram_leaves_incomplete_rows_out_of_every_sum(spark, monkeypatch):
    rows = [(0, float(i), float(i * i) if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    z = [F.lit(1.0), F.col("a"), F.col("b")]
    kept = np.array([[1.0, a, b] for _, a, b in rows if b is not None])
    for limit in (400, 0):                      # both plans
        monkeypatch.setattr(ln, "SQL_GRAM_LIMIT", limit)
        r = ln.gram(df, z, ["k"]).first()
        assert r["n"] == len(kept) and np.allclose(gm.unpack(r["g"], 3), kept.T @ kept)


def test_split_follows_each_series(spark):
    rng = np.random.default_rng(2)
    data = {k: rng.normal(size=n).cumsum() for k, n in (("a", 100), ("b", 40), ("c", 3))}
    rows = [(k, i, float(x)) for k, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "s string, idx long, y double")
    got = ln.walk_forward(df, ["y"], 1, split=0.8, keys=["s"], size=16).toPandas().sort_values(["s", "idx"])
    assert got.groupby("s").idx.min().to_dict() == {"a": 80, "b": 32}
    for r in got.itertuples():
        y = data[r.s]
        fit = np.polyfit(y[:r.idx - 1], y[1:r.idx], 1)
        assert r.predicted == pytest.approx(np.polyval(fit, y[r.idx - 1]), abs=1e-7)


def test_stacked_fits_of_singular_grams():
    z = np.ones((5, 3))
    beta = gm.stacked_ols(np.stack([z.T @ z, np.eye(3)]), 2)
    assert np.isfinite(beta).all() and np.allclose(beta[0].sum(), 1.0)


def test_imputation_of_chosen_subjects(spark):
    rows = [(s, v, None if v % 3 == 1 else float(s + v), float(v)) for s in (1, 2) for v in range(12)]
    df = spark.createDataFrame(rows, "s long, v long, x double, y double")
    for method, kw in (("locf", {}), ("nocb", {}), ("chained", {}), ("forest", {"num_trees": 3, "max_iter": 2})):
        out = im.impute(method, df, ["x", "y"], "s", "v", subject_ids=[1], **kw).toPandas()
        assert len(out) == len(rows)
        assert out[out.s == 2].x.isna().sum() == 4 and out[(out.s == 1) & (out.v > 1)].x.isna().sum() == 0
    everyone = im.impute("chained", df, ["x", "y"], "s", "v").toPandas()
    assert everyone.x.isna().sum() == 0
    with pytest.raises(ValueError, match="missing"):
        im.impute("locf", df.fillna(0.0), ["x", "y"], "s", "v")


def test_rbm_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.integers(0, 2, (200, 4)).astype(float), columns=list("abcd"))
    pdf["id"] = np.arange(200)
    df = spark.createDataFrame(pdf)
    w = [lr.rbm_structure(df.repartition(n), 3, n_iter=4, row_id="id").orderBy("hidden", "column").toPandas().weight for n in (1, 5)]
    assert np.allclose(w[0], w[1], atol=1e-9)


def test_one_hot_of_more_levels_than_columns(spark):
    df = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"))
    out = tf.one_hot_sparse(df, ["v"], "row")
    levels = sorted(i for i in range(3000) if i % 7)
    assert out.count() == 3000 and out.agg(F.max("n_levels")).first()[0] == len(levels) + 1
    got = {r["row"]: r["level"] for r in out.collect()}
    assert all(got[v] == k for k, v in enumerate(levels)) and got[0] == len(levels)


def test_broadcast_only_by_bytes(spark):
    small = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert "broadcast" in va.maybe_broadcast(small, 1 << 20)._jdf.queryExecution().toString().lower()
    assert va.maybe_broadcast(small, 50_000) is small


def test_checkpoint_folder_must_be_named_on_a_cluster(monkeypatch):
    from chronoframe import session as ss

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ss.ensure_checkpoint_dir(Session())


def test_summary_of_one_subject_rounded(spark):
    from chronoframe.operators import missing as ms
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 1.0), (2, 5.0)], "s long, x double")
    r = ms.column_summary(df, ["x"], subject="s", subject_ids=[1], decimals=3).first()
    assert (r.observations, r.n_missing, r.missing_share, r.n_distinct, r.distinct_share) == (3, 1, 0.333, 1, 0.333)


def test_power_search_widens_until_the_maximum_is_inside(spark):
    from chronoframe.operators.power import stabilize_variance
    x = (np.random.default_rng(9).normal(100, 3, 400)).clip(1) ** 0.2
    _, lam = stabilize_variance(spark.createDataFrame(pd.DataFrame({"x": x})), "x")
    assert lam > 2.0                              # outside the first window
    with pytest.raises(ValueError, match="no maximum"):
        stabilize_variance(spark.createDataFrame(pd.DataFrame({"x": [3.0] * 20})), "x")

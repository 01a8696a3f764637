"""Many small groups in one Python call, and the operators that rely on it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from chronoframe.functions.gram import ols_each, ols_from_gram
from chronoframe.operators import learn as ln
from chronoframe.operators.groups import map_groups
from chronoframe.operators.many_series import arima_grid, arima_many
from chronoframe.operators.spline import spline_interpolate


@pytest.fixture
def no_call_per_group(monkeypatch):
    def refuse(*args, **kw):
        raise AssertionError("one Python call per group")
    monkeypatch.setattr(GroupedData, "applyInPandas", refuse)
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", refuse)


@pytest.fixture(scope="module")
def users(spark):
    """60 users of 40 rows, every seventh value missing."""
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(u, i, None if (u + i) % 7 == 0 else float(v)) for u in range(60) for i, v in enumerate(rng.normal(size=40))],
                                 "u long, idx long, value double").repartition(5).cache()


def test_groups_across_batches(spark):
    """Groups longer and shorter than a batch, keys beyond 2^53 and a NULL key."""
    sizes = {2 ** 53 + 1: 1, 2 ** 53 + 2: 9, None: 3, 5: 4, 6: 1, 7: 17}
    df = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "k long, i long").repartition(4)

    def first_rows(table, starts):
        ends = [*starts[1:], table.num_rows]
        i = table.column("i").to_pylist()
        assert all(i[a:b] == list(range(b - a)) for a, b in zip(starts, ends))
        return {"k": table.column("k").take(pa.array(starts)), "n": np.array(ends) - starts}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = map_groups(df, ["k"], ["i"], first_rows, "k long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(sizes) and {r.k: r.n for r in got} == sizes


def test_stacked_solves_equal_single_ones():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(6, 30, 4))
    z[2, :, 1] = z[2, :, 0]                     # collinear
    z[3, :, 1] = 0.0
    G = np.einsum("nri,nrj->nij", z, z)
    many = ols_each(G, [0, 1, 2], [3])
    for i, g in enumerate(G):
        for a, b in zip(many, ols_from_gram(g, [0, 1, 2], [3], 30)):
            assert np.allclose(a[i], b, rtol=1e-9, atol=1e-12)


def test_arima_of_many_series(users, no_call_per_group):
    full = users.withColumn("value", F.coalesce("value", F.lit(0.1)))
    assert arima_many(full, (1, 0, 1), keys=["u"])[0].select("u").distinct().count() == 60
    assert arima_grid(full, 2, 2, keys=["u"]).count() == 60 * 4


def test_model_impute_of_many_series(users, no_call_per_group):
    out = ln.model_impute(users, "value", ar_lag=1, keys=["u"])
    assert out.count() == 2400 and out.where("value IS NULL").count() == out.where("idx = 0 AND value IS NULL").count()


def test_spline_of_many_series(users, no_call_per_group):
    got = spline_interpolate(users, ["value"], order=1, keys=["u"])
    rows = {(r.u, r.idx): r.value for r in got.collect()}
    seen = {(r.u, r.idx): r.value for r in users.collect()}
    assert len(rows) == 2400
    for (u, i), v in seen.items():
        if v is None and 0 < i < 39:
            assert rows[u, i] == pytest.approx((seen[u, i - 1] + seen[u, i + 1]) / 2)


@pytest.mark.parametrize("decay", [0.0, 0.3, 1e-3, 1.0])
def test_trace_over_blocks(spark, decay):
    """330 rows: more than fit into a block of weights at the smaller decays."""
    x = np.random.default_rng(3).normal(size=330)
    df = spark.createDataFrame([(s, v, float(x[v]) * s) for s, n in ((1, 330), (2, 50)) for v in range(n)], "s long, v long, x double")
    got = ln.decayed_trace(df, ["x"], "v", "s", delay=2, decay=decay, size=128).toPandas().sort_values(["s", "v"])
    assert len(got) == 380
    for s, g in got.groupby("s"):
        a, want = 0.0, []
        for v in range(len(g)):
            a = decay * a + (x[v - 2] * s if v >= 2 else 0.0)
            want.append(a)
        assert np.allclose(g.x_trace, want, atol=1e-12)


def test_trace_of_many_subjects(users, no_call_per_group):
    out = ln.decayed_trace(users.fillna(0.0), ["value"], "idx", "u", delay=1, decay=0.5)
    assert out.count() == 2400 and out.columns == ["u", "idx", "value", "value_lag1", "value_trace"]

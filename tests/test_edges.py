"""Edge inputs: empty, one row, all-NULL column, constant column, leading and
trailing gaps, NaN vs NULL, ties on bin edges (FIXTURES edge_*)."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import diagnostics as dg
from chronoframe.operators import impute as im
from chronoframe.operators import missing as ms
from chronoframe.operators import transform as tf


@pytest.fixture(scope="module")
def gaps(spark):
    # leading gap, interior gap, trailing gap; a constant and an all-NULL column
    x = [None, None, 1.0, 2.0, None, None, 5.0, 6.0, None]
    return spark.createDataFrame(pd.DataFrame({
        "idx": np.arange(9), "x": x, "c": [3.0] * 9, "z": [None] * 9}).astype({"z": "float64"}))


def test_all_null_and_constant_profile(gaps):
    p = ms.missing_profile(gaps, ["x", "c", "z"]).toPandas().set_index("variable")
    assert p.loc["c", "tier"] == "none" and p.loc["z", "tier"] == "high" and p.loc["x", "n_missing"] == 5


def test_fills_leave_all_null_and_leading_gap(gaps):
    f = im.locf(gaps, ["x", "z"], "idx").toPandas().sort_values("idx")
    assert f.x.isna().tolist()[:2] == [True, True] and f.x.iloc[-1] == 6.0 and f.z.isna().all()
    b = im.locf(gaps, ["x"], "idx", nocb=True).toPandas().sort_values("idx")
    assert b.x.iloc[0] == 1.0


def test_interpolate_leading_missing_trailing_extrapolated(gaps):
    f = im.interpolate(gaps, ["x", "z"], order=1).toPandas().sort_values("idx")
    assert f.x.isna().tolist()[:2] == [True, True]
    assert f.x.iloc[4] == pytest.approx(3.0) and f.x.iloc[5] == pytest.approx(4.0)
    assert f.x.iloc[8] == pytest.approx(7.0)
    assert f.z.isna().all()


def test_nearest_mean_empty_neighbourhood_stays_missing(spark):
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(8), "x": [1.0] + [None] * 6 + [2.0]}))
    f = im.nearest_mean(df, ["x"], n=2).toPandas().sort_values("idx")
    assert f.x.iloc[1] == 1.0 and math.isnan(f.x.iloc[4]) and f.x.iloc[6] == 2.0


def test_constant_series(spark, gaps):
    a = dg.acf(dg.long_series(gaps, ["c"]), nlags=2).toPandas()
    assert a.acf.isna().all()                                   # zero variance: undefined, not an error
    s, _ = tf.minmax_scale(gaps.select("idx", "c"), ["c"])
    assert set(s.toPandas().c) == {-1.0}
    b, edges = tf.bin_equal_width(gaps, "c", 3, out="code")
    assert set(b.toPandas().code) == {1} and edges[0] < 3.0 < edges[-1]


def test_one_row_and_empty(spark):
    one = spark.createDataFrame([(0, 1.0)], "idx long, x double")
    assert tf.difference(one, ["x"]).count() == 0
    a = dg.acf(dg.long_series(one, ["x"])).toPandas()
    assert a.lag.tolist() == [0]
    empty = spark.createDataFrame([], "idx long, x double")
    p = ms.missing_profile(empty, ["x"]).first()
    assert p["n_rows"] == 0 and p["missing_share"] is None


def test_nan_is_missing(spark):
    df = spark.createDataFrame(pd.DataFrame({"idx": [0, 1, 2], "x": [1.0, float("nan"), 3.0]}))
    n = ms.normalise_nan(df)
    assert n.where(F.col("x").isNull()).count() == 1


def test_label_classes_around_nan(spark):
    df = spark.createDataFrame([("NaN",), (None,), ("Zed",), ("apple",)], "c string")
    enc, mapping = tf.label_encode(df, "c", out="code")
    m = {r["class"]: r["code"] for r in mapping.collect()}
    assert m == {"NaN": 0, "Zed": 1, "apple": 2}                # binary order; NULL joins the 'NaN' class
    got = {r["c"]: r["code"] for r in enc.collect()}
    assert got[None] is None and got["NaN"] == 0


def test_seasonal_multiplicative_zero_trend_is_null(spark):
    df = spark.createDataFrame(pd.DataFrame({"variable": "v", "idx": np.arange(8),
                                             "value": [0.0, 0.0, 0.0, 1.0, 2.0, 1.0, 2.0, 1.0]}))
    out = dg.seasonal_decompose(df, period=3, model="multiplicative").toPandas().sort_values("idx")
    assert len(out) == 8 and out.trend.iloc[1] == 0.0

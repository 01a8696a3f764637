"""Small relations of their own: bands, fitted values, pairs, options, forecast input."""

import pytest

from chronoframe.operators import results as rs
from chronoframe.operators import transform as tf
from chronoframe.sources.csv import subject_options


def test_bands_keep_the_steps_of_all_three_frames(spark):
    frame = lambda steps, add: spark.createDataFrame([("a", i, i + add) for i in steps], "k string, idx long, v double")
    out = rs.join_bands(frame([1, 2, 3], 0.0), frame([2, 3, 4], -1.0), frame([3, 2], 1.0), keys=["k"]).orderBy("idx").collect()
    assert [tuple(r) for r in out] == [("a", 2, 2.0, 1.0, 3.0), ("a", 3, 3.0, 2.0, 4.0)]
    with pytest.raises(ValueError):
        rs.join_bands(frame([1], 0.0).withColumnRenamed("k", "other"), frame([1], 0.0), frame([1], 0.0))


def test_fitted_values_end_in_nulls(spark):
    obs = spark.createDataFrame([(i, float(i)) for i in range(4)], "idx long, y double")
    fit = spark.createDataFrame([(0, 0.5), (1, 1.5)], "idx long, f double")
    assert [r.f for r in rs.observed_and_fitted(obs, fit).orderBy("idx").collect()] == [0.5, 1.5, None, None]


def test_pairs_and_options(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, None), ("x", 1)], "v string, s long")
    assert sorted(tuple(r) for r in rs.ordered_pairs(df.where("v IS NOT NULL"), "v").collect()) == [("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]
    assert sorted(r.option for r in subject_options(df, "s", add_all=True).collect()) == ["1", "2", "all"]
    assert sorted(r.option for r in subject_options(df, "s").collect()) == ["1", "2"]


def test_last_windows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "idx long, y double").repartition(3)
    out = tf.last_windows(df, ["y"], 2, last_step=2, size=2).orderBy("idx").collect()
    assert [tuple(r) for r in out] == [(4, 4.0, 3.0, 2.0), (5, 5.0, 4.0, 3.0)]
    whole = tf.last_windows(df, ["y"], 2, last_step=9, size=2).orderBy("idx").collect()
    assert [tuple(r) for r in whole][:2] == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)]

"""Many series at once against the models of one series."""

import numpy as np
import pytest
from fixture_paths import SF0001
from pyspark.sql import functions as F

from chronoframe.operators import linear as ln
from chronoframe.operators.many_series import arima_grid, arima_many


@pytest.fixture(scope="module")
def series(spark):
    """Three series of unequal length, shuffled, and one that is too short."""
    rng = np.random.default_rng(2)
    rows = []
    for name, n, phi, theta in (("a", 400, 0.7, 0.3), ("b", 150, -0.4, 0.5), ("c", 90, 0.5, 0.0), ("d", 3, 0.1, 0.1)):
        e = rng.normal(size=n + 1)
        y = np.zeros(n)
        for t in range(n):
            y[t] = (phi * y[t - 1] if t else 0) + e[t + 1] + theta * e[t] + (2.0 if t % 7 == 0 else 0.0)
        rows += [(name, i, float(v)) for i, v in enumerate(y)]
    rng.shuffle(rows)
    return spark.createDataFrame([(a, int(b), float(c)) for a, b, c in rows], "s string, idx long, value double").repartition(6).cache()


MODELS = [((1, 0, 0), None), ((1, 0, 1), None), ((2, 1, 1), None), ((0, 1, 0), (1, 0, 1, 7)), ((0, 0, 0), (1, 0, 0, 7))]


@pytest.mark.parametrize("order,seasonal", MODELS)
def test_equals_one_series_at_a_time(series, order, seasonal):
    coefs, fc = arima_many(series, order, seasonal, steps=6, keys=["s"], size=64)
    coefs, fc = coefs.collect(), fc.collect()
    assert {r.s for r in coefs} == {r.s for r in fc} == {"a", "b", "c"}
    for name in "abc":
        own_c, own_f = ln.sarima(series.where(F.col("s") == name).drop("s"), order, seasonal, steps=6)
        want = {r.term: (r.coef, r.std_err) for r in own_c.collect()}
        got = {r.term: (r.coef, r.std_err) for r in coefs if r.s == name}
        assert got.keys() == want.keys()
        for t in want:
            assert got[t][0] == pytest.approx(want[t][0], rel=1e-7, abs=1e-9)
            assert (got[t][1] is None) == (want[t][1] is None)
        mine = {r.idx: r for r in fc if r.s == name}
        for r in own_f.collect():
            for c in ("mean", "lower", "upper"):
                assert mine[r.idx][c] == pytest.approx(r[c], rel=1e-6, abs=1e-8)


def test_grid_equals_one_series(series):
    got = arima_grid(series, 3, 2, keys=["s"]).collect()
    for name in "ac":
        want = {(r.p, r.q): r for r in ln.arma_grid(series.where(F.col("s") == name).drop("s"), 3, 2).collect()}
        mine = {(r.p, r.q): r for r in got if r.s == name}
        assert mine.keys() == want.keys()
        for k in want:
            assert mine[k].nobs == want[k].nobs
            for c in ("aic", "aicc", "bic"):
                assert mine[k][c] == pytest.approx(want[k][c], rel=1e-8)
    assert not [r for r in got if r.s == "d"]


def test_seasonal_grid_prefers_the_planted_period(series):
    rows = arima_grid(series, 2, 1, s=7, keys=["s"]).collect()
    best = min((r for r in rows if r.s == "a"), key=lambda r: r.bic)
    assert best.p == 1


def test_var_forecast_by_key(spark, series):
    two = series.where("s <> 'd'").withColumn("w", F.sin(F.col("value") + F.col("idx")))
    fit = ln.var_fit(two, ["value", "w"], 2, keys=["s"])
    got = ln.var_forecast(two, ["value", "w"], fit, 2, 4, keys=["s"]).collect()
    assert len(got) == 3 * 2 * 4
    for name in "ab":
        one = two.where(F.col("s") == name).drop("s")
        want = {(r.variable, r.idx): r for r in ln.var_forecast(one, ["value", "w"], ln.var_fit(one, ["value", "w"], 2), 2, 4).collect()}
        for r in got:
            if r.s == name:
                assert r.mean == pytest.approx(want[r.variable, r.idx].mean, rel=1e-8, abs=1e-10)
                assert r.upper == pytest.approx(want[r.variable, r.idx].upper, rel=1e-8, abs=1e-10)


def test_nothing(series):
    coefs, fc = arima_many(series.limit(0), (1, 0, 1), steps=2, keys=["s"])
    assert coefs.collect() == [] and fc.collect() == []


def test_registered_queries(spark):
    import __spark_entry__ as entry
    for name in ("user_arma_fit", "segment_seasonal_grid", "segment_sarima_forecast", "segment_var_forecast"):
        assert entry.queries()[name](spark, SF0001).count() > 0

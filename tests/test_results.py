"""Result shaping, dispatchers, guards and small helpers."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import diagnostics as dg
from chronoframe.operators import impute as im
from chronoframe.operators import linear as ln
from chronoframe.operators import missing as ms
from chronoframe.operators import results as rs
from chronoframe.operators import transform as tf


def test_inject_missing_is_deterministic(spark):
    df = spark.range(200).select(F.col("id").alias("idx"), (F.col("id") * 1.0).alias("x"))
    a = ms.inject_missing(df, ["x"], 15, seed=3).where(F.col("x").isNull()).select("idx").toPandas()
    b = ms.inject_missing(df, ["x"], 15, seed=3).where(F.col("x").isNull()).select("idx").toPandas()
    assert len(a) == 15 and sorted(a.idx) == sorted(b.idx)


def test_reverse_difference_roundtrip_property(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=60))
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(60), "x": x}))
    d2 = tf.difference(df, ["x"], order=2, size=7)
    back = tf.reverse_difference(d2, "x", [x[0], x[1] - x[0]], size=7).toPandas().sort_values("idx")
    assert np.allclose(back.x.to_numpy(), x)


def test_difference_requires_complete(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None)], "idx long, x double")
    with pytest.raises(ValueError):
        tf.difference(df, ["x"])


def test_var_fit_with_exog_matches_lstsq(spark):
    rng = np.random.default_rng(8)
    n = 300
    e = rng.normal(size=n)
    y = np.zeros((n, 2))
    for t in range(1, n):
        y[t] = 0.4 * y[t - 1] + np.array([0.7, -0.2]) * e[t] + 0.1 * rng.normal(size=2)
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "a": y[:, 0], "b": y[:, 1], "e": e}))
    got = ln.var_fit(df, ["a", "b"], 1, exog=["e"]).toPandas()
    rows = np.arange(1, n)
    X = np.column_stack([np.ones(len(rows)), y[rows - 1], e[rows]])
    B, *_ = np.linalg.lstsq(X, y[rows], rcond=None)
    v = got[(got.equation == "a") & (got.regressor == "e")].coef.iloc[0]
    assert abs(v - B[3, 0]) < 1e-8


def test_upsert_resets_on_test_size_change(spark):
    cur = spark.createDataFrame([("VAR", "a", 1.0, 100), ("AR", "a", 2.0, 100)],
                                "model string, variable string, mae double, test_size int")
    new = spark.createDataFrame([("VAR", "a", 0.5, 101)], "model string, variable string, mae double, test_size int")
    kept = rs.upsert_results(cur, new).toPandas().set_index("model")
    assert kept.loc["VAR", "mae"] == 0.5 and "AR" in kept.index
    new2 = spark.createDataFrame([("VAR", "a", 0.4, 110)], "model string, variable string, mae double, test_size int")
    assert rs.upsert_results(cur, new2).count() == 1


def test_draw_interval_population_std(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0)], "step int, value double")
    r = rs.draw_interval(df, ["step"]).first()
    assert r["mean"] == 2.0 and r["lower"] == 0.0 and r["upper"] == 4.0


def test_walk_order_and_minima(spark):
    grid = spark.createDataFrame([(p, q, float((p - 1) ** 2 + (q - 2) ** 2)) for p in range(3) for q in range(3)],
                                 "p int, q int, aic double")
    m = rs.running_minima(grid, ["aic"], [rs.walk_order(3, 3)]).toPandas()
    vals = m.value.tolist()
    assert all(a > b for a, b in zip(vals, vals[1:])) and vals[-1] == 0.0


def test_plot_tables(spark):
    obs = spark.createDataFrame([("a", 0, 1.0)], "variable string, idx long, value double")
    pred = spark.createDataFrame([("a", 0, 1.5)], "variable string, idx long, predicted double")
    fc = spark.createDataFrame([("a", 1, 2.0, 1.0, 3.0)], "variable string, idx long, mean double, lower double, upper double")
    t = rs.forecast_plot_table(obs, pred, fc).toPandas()
    assert set(t.kind) == {"observed", "predicted", "forecast"}
    acf = spark.createDataFrame([("a", 1, 0.1)], "variable string, lag long, acf double")
    assert dg.plot_bands(acf, nobs=100, kind="residual").first()["gap"] == 0.2


def test_impute_dispatcher_rejects_unknown(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "s long, v long, x double")
    with pytest.raises(ValueError):
        im.impute("spline", df, ["x"], "s", "v")


def test_drop_high_missing_and_has_missing(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, 2.0), (2, 3.0, None), (2, 4.0, 5.0)],
                               "s long, a double, b double")
    assert ms.has_missing(df, ["a", "b"])
    kept = ms.drop_high_missing(df, "s", threshold=0.3).columns
    assert kept == ["s", "b"]


def test_label_encode_nan_shift(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    enc, mapping = tf.label_encode(df, "c", out="code")
    m = {r["class"]: r["code"] for r in mapping.collect()}
    assert m == {"NaN": 0, "a": 1, "b": 2}
    codes = [r["code"] for r in enc.collect() if r["c"] is None]
    assert codes == [None]


def test_bin_equal_width_edges_and_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    out, edges = tf.bin_equal_width(df, "x", 5, out="code")
    got = {r["x"]: r["code"] for r in out.collect()}
    assert got[0.0] == 0 and got[2.0] == 0 and got[2.0000001 if 2.0000001 in got else 3.0] == 1 and got[10.0] == 4
    assert abs(edges[0] - (0 - 0.01)) < 1e-12
    lab, _ = tf.bin_equal_width(df, "x", 5, encode=False)
    assert lab.where(F.col("x").isNull()).count() == 0
    assert lab.first()["x"] == "(-0.01, 2.0]"


@pytest.mark.parametrize("shift", [1.0, -3.0])
def test_power_transform_lambda_is_ml(spark, shift):
    from chronoframe.operators.power import stabilize_variance
    rng = np.random.default_rng(12)
    x = np.exp(rng.normal(size=500) * 0.5) + shift          # positive -> Box-Cox, else Yeo-Johnson
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out, lam = stabilize_variance(df, "x")

    def llf(l):
        if x.min() > 0:
            y = np.log(x) if abs(l) < 1e-12 else (x ** l - 1) / l
            return (l - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())
        pos = x >= 0
        y = np.empty_like(x)
        y[pos] = np.log1p(x[pos]) if abs(l) < 1e-12 else ((x[pos] + 1) ** l - 1) / l
        y[~pos] = -np.log1p(-x[~pos]) if abs(l - 2) < 1e-12 else -((-x[~pos] + 1) ** (2 - l) - 1) / (2 - l)
        return (l - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum() - len(x) / 2 * np.log(y.var())

    grid = np.linspace(lam - 0.5, lam + 0.5, 2001)
    best = grid[np.argmax([llf(g) for g in grid])]
    assert abs(lam - best) < 1e-3


def test_ui_preconditions(spark):
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(50), "a": np.arange(50.0), "b": np.arange(50.0) ** 0.5}))
    with pytest.raises(ValueError):
        ln.var_param_search(df, ["a", "b"], 1)
    with pytest.raises(ValueError):
        ln.var_param_search(df, ["a"], 3)
    with pytest.raises(ValueError):
        tf.supervised_windows(df, ["a"], 2, 4, 10, s=3)
    with pytest.raises(ValueError):
        tf.bin_equal_width(df, "a", 1)
    with pytest.raises(ValueError):
        im.interpolate(df, ["a"], order=6)


WALKS = {
    (3, 3): [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1), (2, 1), (1, 2), (2, 2)],
    (4, 2): [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (3, 0), (2, 1), (3, 1)],
    (2, 5): [(0, 0), (1, 0), (0, 1), (0, 2), (1, 1), (0, 3), (1, 2), (0, 4), (1, 3), (1, 4)],
}


@pytest.mark.parametrize("lp,lq", list(WALKS))
def test_walk_order_of_three_grids(spark, lp, lq):
    grid = spark.createDataFrame([(p, q) for p in range(lp) for q in range(lq)], "p int, q int")
    got = [(r["p"], r["q"]) for r in grid.orderBy(rs.walk_order(lp, lq)).collect()]
    assert got == WALKS[lp, lq]

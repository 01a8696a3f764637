"""Re-aimed learned models: properties (no leaks across subjects, gaps filled,
rounding, bounded outputs) and a planted-signal check."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import learn as ln
from chronoframe.operators import transform as tf


def test_model_impute_fills_all_but_leading_gap(spark):
    n = 300
    rng = np.random.default_rng(0)
    x = np.zeros(n)
    x[:2] = [5.0, 6.0]
    for t in range(2, n):                     # planted AR(2) with constant
        x[t] = 1.2 * x[t - 1] - 0.5 * x[t - 2] + 1.0 + rng.normal(scale=0.01)
    s = pd.Series(x.copy())
    s[[0, 1, 50, 51, 52, 200]] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "x": s}))
    out = ln.model_impute(df, "x", ar_lag=2).toPandas().sort_values("idx")
    assert out.x.isna().tolist()[:2] == [True, True]
    assert out.x.iloc[2:].notna().all()
    assert abs(out.x.iloc[51] - x[51]) < 0.1 and abs(out.x.iloc[52] - x[52]) < 0.1


def test_chained_impute_rounds_and_completes(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=400)
    b = 2 * a + rng.normal(scale=0.01, size=400)
    b[::10] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "a": a, "b": b}))
    out = ln.chained_impute(df, ["a", "b"]).toPandas().sort_values("id")
    assert out.b.notna().all()
    assert np.allclose(out.b, out.b.round(3))
    miss = np.isnan(b)
    assert np.max(np.abs(out.b.to_numpy()[miss] - 2 * a[miss])) < 0.1


def test_chained_impute_needs_two_columns(spark):
    df = spark.createDataFrame([(1, 1.0)], "id long, a double")
    with pytest.raises(ValueError):
        ln.chained_impute(df, ["a"])


def test_forest_impute_categories_valid(spark):
    rng = np.random.default_rng(2)
    n = 300
    a = rng.normal(size=n)
    cat = np.where(a > 0, "pos", "neg").astype(object)
    cat[::13] = None
    v = a * 3
    v[::17] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "c": cat, "v": v, "a": a}))
    out = ln.forest_impute(df, ["c", "v", "a"], categorical=["c"], max_iter=2, num_trees=10).toPandas()
    assert out.c.notna().all() and set(out.c) <= {"pos", "neg"}
    assert out.v.notna().all()


def test_decayed_trace_matches_loop(spark):
    rows = []
    for s, n in [(1, 40), (2, 7)]:
        for t in range(n):
            rows.append((s, t, float((t * 7 + s) % 5)))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["sid", "visit", "x"]))
    got = ln.decayed_trace(df, ["x"], "visit", "sid", delay=2, decay=0.5, size=6).toPandas()
    for s, g in got.groupby("sid"):
        g = g.sort_values("visit")
        xs = g.x.to_numpy()
        a, exp = 0.0, []
        for t in range(len(xs)):
            a = 0.5 * a + (xs[t - 2] if t >= 2 else 0.0)
            exp.append(a)
        assert np.allclose(g.x_trace.to_numpy(), exp)


def test_window_regression_shapes(spark):
    n = 200
    t = np.arange(n)
    df = spark.createDataFrame(pd.DataFrame({"idx": t, "a": np.sin(t / 4.0), "b": np.cos(t / 4.0)}))
    pred, loss, models, _ = ln.window_regression(df, ["a", "b"], order=2, horizon=2, split=150, outputs=["a"])
    p = pred.toPandas()
    assert set(p.variable) == {"a"}
    assert p.predicted.notna().all()
    test = p[p.set == "test"]
    assert np.mean(np.abs(test.predicted - test.observed)) < 0.05


def test_rbm_structure_shape(spark):
    df = spark.createDataFrame(pd.DataFrame({"c": ["x", "y", "z", "x"] * 25, "b": [0, 1] * 50}))
    enc, widths = tf.encode_for_rbm(df, ["c", "b"])
    assert widths == [("c", 3), ("b", 1)]
    w = ln.rbm_structure(enc, n_hidden=2, n_iter=3).toPandas()
    assert len(w) == 2 * 4 and w.weight.notna().all()


def test_sensitivity_of_linear_model_is_its_coefficients(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(6)
    X = rng.normal(size=(300, 2))
    y = 3 * X[:, 0] - 2 * X[:, 1] + 0.5
    df = spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": y}))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = LinearRegression(featuresCol="features", labelCol="y").fit(data)
    s = ln.sensitivity(m, data, ["a", "b"]).toPandas().set_index("feature").sensitivity
    assert abs(s["a"] - 3) < 1e-6 and abs(s["b"] + 2) < 1e-6


def test_forecast_recursive_linear_process(spark):
    n = 300
    t = np.arange(n)
    x = 5.0 + 0.05 * t                                        # a line: every draw predicts it exactly
    df = spark.createDataFrame(pd.DataFrame({"idx": t, "x": x}))
    fc = ln.forecast_recursive(df, ["x"], order=1, steps=6, draws=3, horizon=2).toPandas().sort_values("idx")
    assert fc.idx.tolist() == list(range(n, n + 6))
    assert np.allclose(fc["mean"].to_numpy(), 5.0 + 0.05 * np.arange(n, n + 6), atol=1e-3)
    assert (fc.upper >= fc.lower).all()


def _steps(spark, n_subjects=30, n=25):
    """The next kind follows from the present one, but for one step in ten."""
    rng = np.random.default_rng(8)
    rows = []
    for s in range(n_subjects):
        k = int(rng.integers(3))
        for v in range(n):
            rows.append((s, v, "abc"[k], float(k)))
            k = (k + 1) % 3 if rng.random() > 0.1 else int(rng.integers(3))
    return spark.createDataFrame(rows, "s long, v long, kind string, x double")


def test_window_classifier_learns_the_planted_rule(spark):
    df = _steps(spark)
    lead = df.selectExpr("s", "v", "x", "lead(kind) over (partition by s order by v) as nxt")
    held = df.where("s >= 24").select("s").distinct()
    out = ln.window_classifier(lead, "s", "v", ["x"], "nxt", 2, held, iters=(1, 60)).toPandas().set_index("max_iter")
    assert out.accuracy[60] > 0.85 and out.val_accuracy[60] > 0.8
    assert out.accuracy[60] >= out.accuracy[1]


def test_dynamic_classifier_tables(spark):
    df = _steps(spark)
    held = df.where("s >= 24").select("s").distinct()
    metrics, groups, weights = ln.dynamic_classifier(df, "s", "v", ["kind"], "kind", delay=2, test_subjects=held)
    m = metrics.toPandas().set_index("set")
    assert m.recall["train"] > 0.85 and m.recall["test"] > 0.8 and m.n.sum() == 30 * 24
    g = groups.toPandas()
    assert len(g) == 30 and set(g.group_correct) <= {0, 1}
    w = weights.toPandas().pivot(index="output", columns="input", values="weight")
    assert w.shape == (3, 3)


def test_decayed_trace_against_a_loop(spark):
    df = spark.createDataFrame([(s, v, float((s + 1) * v % 5)) for s in (1, 2) for v in range(40)], "s long, v long, x double")
    got = ln.decayed_trace(df, ["x"], "v", "s", delay=2, decay=0.7, size=8).toPandas().sort_values(["s", "v"])
    for s, g in got.groupby("s"):
        a, want = 0.0, []
        for v in range(40):
            a = 0.7 * a + (float((s + 1) * (v - 2) % 5) if v >= 2 else 0.0)
            want.append(a)
        assert np.allclose(g.x_trace, want)


def test_rbm_runs_epochs_of_mini_batches(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "one": 1, "a": np.arange(600) % 2}))
    for rows in (2000, 100):
        w = ln.rbm_structure(df, n_hidden=2, n_iter=10, row_id="id", shard_rows=rows).toPandas()
        assert w[w.column == "one"].weight.min() > 0.5      # ten full-batch updates get to 0.2


def test_rbm_structure_reads_documents_without_labels(spark):
    from chronoframe.plans import queries
    sf = "/root/testdata/sf0.001"
    got = {r.column for r in queries.rbm_structure(spark, sf).collect()}
    assert {"quality_2", "toxic_2"} <= got      # the level of what has no label


def test_dynamic_classifier_keeps_events_without_type(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from chronoframe.plans import fixtures as fx
    from chronoframe.plans import queries
    sf = "/root/testdata/sf0.001"
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("visit"))
    want = fx.ld_events(spark, sf).select(after.alias("next")).where("next IS NOT NULL").count()
    metrics, _, weights = queries._dynamic(spark, sf)
    assert sum(r.n for r in metrics.collect()) == want
    assert weights.select("input").distinct().count() == 5

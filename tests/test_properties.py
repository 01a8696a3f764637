"""Property tests (hypothesis): few examples each, since every example runs Spark jobs."""
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe.operators import impute as im
from chronoframe.operators import linear as ln
from chronoframe.operators import missing as ms
from chronoframe.operators import ordering as o
from chronoframe.operators import transform as tf

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

series = st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False)), min_size=1, max_size=60)


def _frame(spark, vals, subjects=None):
    n = len(vals)
    s = subjects if subjects is not None else [0] * n
    pdf = pd.DataFrame({"s": s, "idx": np.arange(n), "x": pd.array(vals, dtype="Float64").astype("float64")})
    pdf["idx"] = pdf.groupby("s").cumcount()
    return spark.createDataFrame(pdf[["s", "idx", "x"]], "s long, idx long, x double"), pdf


@SETTINGS
@given(vals=series, size=st.integers(1, 20), lag=st.integers(1, 5))
def test_halo_lag_equals_shift(spark, vals, size, lag):
    if lag > size:
        return
    df, pdf = _frame(spark, vals)
    got = o.lagged(df, ["x"], lags=[lag], leads=[lag], size=size).toPandas().sort_values("idx")
    assert np.allclose(got[f"x_lag{lag}"].to_numpy(dtype=float), pdf.x.shift(lag).to_numpy(dtype=float), equal_nan=True)
    assert np.allclose(got[f"x_lead{lag}"].to_numpy(dtype=float), pdf.x.shift(-lag).to_numpy(dtype=float), equal_nan=True)


@SETTINGS
@given(vals=series, size=st.integers(1, 16), data=st.data())
def test_locf_idempotent_and_subject_local(spark, vals, size, data):
    subjects = data.draw(st.lists(st.integers(0, 3), min_size=len(vals), max_size=len(vals)))
    df, pdf = _frame(spark, vals, sorted(subjects))
    once = im.locf(df, ["x"], "idx", "s", size=size)
    twice = im.locf(once, ["x"], "idx", "s", size=size)
    a = once.toPandas().sort_values(["s", "idx"]).x.to_numpy(dtype=float)
    b = twice.toPandas().sort_values(["s", "idx"]).x.to_numpy(dtype=float)
    exp = pdf.sort_values(["s", "idx"]).groupby("s").x.ffill().to_numpy(dtype=float)
    assert np.allclose(a, b, equal_nan=True) and np.allclose(a, exp, equal_nan=True)


@SETTINGS
@given(p=st.lists(st.floats(0, 1), min_size=1, max_size=40))
def test_bh_monotone_bounded(spark, p):
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(p)), "p_value": p}))
    q = ln.bh_correct(df, size=4).toPandas().sort_values("p_value")
    assert ((q.q_value >= q.p_value - 1e-12) & (q.q_value <= 1.0)).all()
    assert (np.diff(q.q_value.to_numpy()) >= -1e-12).all()


@SETTINGS
@given(vals=st.lists(st.sampled_from(["a", "b", "c", "d", None]), min_size=3, max_size=40))
def test_one_hot_rows_sum_to_one_and_label_roundtrip(spark, vals):
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(vals)), "c": vals}), "i long, c string")
    out, names = tf.one_hot(df, "c")
    if len(names) > 1:
        sums = out.select(sum(F.col(n) for n in names).alias("t")).toPandas().t
        assert (sums == 1.0).all()
    enc, mapping = tf.label_encode(df, "c", out="code")
    back = enc.join(mapping, "code", "left").toPandas()
    ok = back.c.isna() | (back.c == back["class"])
    assert ok.all() and back[back.c.isna()].code.isna().all()


@SETTINGS
@given(a=st.floats(-100, 100), b=st.floats(-5, 5), n=st.integers(5, 80), k=st.integers(1, 4), seed=st.integers(0, 99))
def test_inject_then_linear_impute_is_exact_on_a_line(spark, a, b, n, k, seed):
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "x": a + b * np.arange(n)}))
    holes = ms.inject_missing(df, ["x"], k, seed=seed)
    got = im.interpolate(holes, ["x"], order=1).toPandas().sort_values("idx")
    filled = got.x.to_numpy(dtype=float)
    exp = a + b * np.arange(n)
    ok = ~np.isnan(filled)
    assert np.allclose(filled[ok], exp[ok], atol=1e-6)
    first_obs = int(np.argmax(holes.toPandas().sort_values("idx").x.notna().to_numpy()))
    assert ok[first_obs:].all()                                # only a leading gap may remain


@SETTINGS
@given(x=st.lists(st.floats(-1e3, 1e3), min_size=4, max_size=50), d=st.integers(1, 3))
def test_reverse_difference_roundtrip(spark, x, d):
    if len(x) <= d:
        return
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(x)), "x": x}))
    diffs = [np.asarray(x, dtype=float)]
    for _ in range(d):
        diffs.append(np.diff(diffs[-1]))
    seeds = [diffs[j][0] for j in range(d)]
    back = tf.reverse_difference(tf.difference(df, ["x"], order=d, size=5), "x", seeds, size=5)
    got = back.toPandas().sort_values("idx").x.to_numpy()
    assert np.allclose(got, x, atol=1e-6 * max(1.0, float(np.max(np.abs(x)))))


@SETTINGS
@given(x=st.lists(st.one_of(st.floats(-50, 50), st.integers(-50, 50).map(float)), min_size=2, max_size=60),
       k=st.integers(2, 40))
def test_equal_width_code_equals_edge_count(spark, x, k):
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out, edges = tf.bin_equal_width(df, "x", k, out="code")
    got = out.toPandas()
    exp = [sum(1 for e in edges[1:-1] if v > e) for v in got.x]
    assert got.code.tolist() == exp

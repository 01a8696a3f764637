"""Gap recursion against the rounds it replaces, and transforms of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import diagnostics as dg
from chronoframe.operators.learn import model_impute


def rounds(y, ar_lag, max_rounds=None):
    """Round by round: fit once, then fill the first missing value of every gap."""
    y = np.array(y, float)

    def lags(v, t):
        return [v[t]] + [v[t - k] if t - k >= 0 and not np.isnan(v[t - k]) else 0.0 for k in range(1, ar_lag)]
    rows = [t for t in range(len(y) - 1) if not np.isnan(y[t]) and not np.isnan(y[t + 1])]
    if len(rows) < ar_lag + 1:
        return y
    x = np.array([[1.0, *lags(y, t)] for t in rows])
    b = np.linalg.lstsq(x, y[[t + 1 for t in rows]], rcond=None)[0]
    done = 0
    while max_rounds is None or done < max_rounds:
        todo = [t for t in range(len(y) - 1) if not np.isnan(y[t]) and np.isnan(y[t + 1])]
        if not todo:
            break
        new = {t + 1: float(b @ [1.0, *lags(y, t)]) for t in todo}
        for t, v in new.items():
            y[t] = v
        done += 1
    return y


@pytest.mark.parametrize("ar_lag,max_rounds", [(1, None), (3, None), (4, 2)])
def test_equals_the_rounds(spark, ar_lag, max_rounds):
    rng = np.random.default_rng(ar_lag)
    series = {}
    for name, n, share in (("a", 180, 0.4), ("b", 60, 0.15), ("c", 4, 0.5), ("d", 30, 1.0)):
        y = np.cumsum(rng.normal(size=n)) * 0.3 + np.sin(np.arange(n))
        y[rng.random(n) < share] = np.nan
        y[:2] = np.nan
        series[name] = y
    series["a"][100:140] = np.nan                # a long gap across blocks
    df = spark.createDataFrame([(s, i, None if np.isnan(v) else float(v), "x") for s, y in series.items() for i, v in enumerate(y)],
                               "s string, idx long, v double, _before string").repartition(5)
    out = model_impute(df, "v", ar_lag=ar_lag, keys=["s"], max_rounds=max_rounds, size=16).collect()
    assert len(out) == df.count()
    for name, y in series.items():
        want = rounds(y, ar_lag, max_rounds)
        got = {r.idx: r.v for r in out if r.s == name}
        for i, v in enumerate(want):
            assert (got[i] is None) == bool(np.isnan(v))
            assert got[i] is None or abs(got[i] - v) < 1e-7


@pytest.mark.parametrize("n", [1009, 1531, 2 * 751])
def test_chirp_transform_of_any_length(spark, n):
    """Lengths without a factor within the block: equal to a plain transform."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    df = spark.createDataFrame([("v", i, float(v)) for i, v in enumerate(x)], "variable string, idx long, value double").repartition(4)
    nt = df.groupBy("variable").agg(F.count(F.lit(1)).alias("_n"))
    got = {r.freq: (r.c, r.s) for r in dg._dft_chirp(df, nt, ["variable"], "idx", "value").collect()}
    spec = np.fft.fft(x)
    for k in got:
        z = spec[k] * np.exp(-2j * np.pi * k / n)
        assert abs(got[k][0] - z.real) < 1e-8 and abs(got[k][1] + z.imag) < 1e-8
    assert len(got) == n // 2
    g = dg.fisher_g(df, size=64).first()
    whole = dg.fisher_g(df, size=100_000).first()
    assert g["g"] == pytest.approx(whole["g"], rel=1e-9) and g["n_freq"] == whole["n_freq"]


def test_chirp_stays_exact_for_long_series(spark):
    """A prime length of 100,003: one sine is one frequency, in groups of about 500 rows."""
    n = 100_003
    df = spark.range(n).select(F.lit("v").alias("variable"), F.col("id").alias("idx"),
                               F.cos(F.lit(2 * np.pi * 1234) * (F.col("id") + 1) / n).alias("value"))
    got = dg.fisher_g(df, size=4096).first()
    assert got["g"] == pytest.approx(1.0, abs=1e-9) and got["n_freq"] == (n - 1) // 2

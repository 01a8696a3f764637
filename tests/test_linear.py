"""Gram-based models against straight numpy re-computations."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.functions import stats as st
from chronoframe.operators import diagnostics as dg
from chronoframe.operators import linear as ln
from chronoframe.plans import queries as q
from fixture_paths import SF001

VARS = q.VARS


@pytest.fixture(scope="module")
def filled(spark):
    return q.hourly_filled(spark, SF001).cache()


@pytest.fixture(scope="module")
def X(filled):
    return filled.toPandas().sort_values("idx")[VARS].to_numpy(dtype=float)


def _ssr(y, Xm):
    b, *_ = np.linalg.lstsq(Xm, y, rcond=None)
    r = y - Xm @ b
    return float(r @ r), b


def test_granger_matches_pairwise_ols(filled, X):
    g = ln.granger(filled, VARS, maxlag=4).toPandas()
    n = len(X)
    for ti, si in [(0, 1), (2, 4), (3, 0)]:
        y, x = X[:, ti], X[:, si]
        for l in range(1, 5):
            rows = np.arange(l, n)
            own = np.column_stack([np.ones(len(rows))] + [y[rows - k] for k in range(1, l + 1)])
            joint = np.column_stack([own] + [x[rows - k] for k in range(1, l + 1)])
            sr, _ = _ssr(y[rows], own)
            su, _ = _ssr(y[rows], joint)
            stat = len(rows) * (sr - su) / su
            got = g[(g.target == VARS[ti]) & (g.source == VARS[si]) & (g.lag == l)].iloc[0]
            assert abs(got.chi2 - stat) < 1e-6 * max(1, stat)
            assert abs(got.p_value - st.chi2_sf(stat, l)) < 1e-9
    assert g[g.target == g.source].chi2.isna().all()


def test_var_fit_matches_lstsq(filled, X):
    p = 2
    got = ln.var_fit(filled, VARS, p).toPandas()
    n = len(X)
    rows = np.arange(p, n)
    Xm = np.column_stack([np.ones(len(rows))] + [X[rows - k] for k in range(1, p + 1)])
    B, *_ = np.linalg.lstsq(Xm, X[rows], rcond=None)
    names = ["const"] + [f"{c}_lag{k}" for k in range(1, p + 1) for c in VARS]
    for e, c in enumerate(VARS):
        for r, nm in enumerate(names):
            v = got[(got.equation == c) & (got.regressor == nm)].coef.iloc[0]
            assert abs(v - B[r, e]) < 1e-7 * max(1, abs(B[r, e]))


def test_var_param_search_own_samples(filled, X):
    got = ln.var_param_search(filled, VARS, 3).toPandas().sort_values("p")
    K, n = len(VARS), len(X)
    for p in range(0, 4):
        rows = np.arange(p, n)
        Xm = np.column_stack([np.ones(len(rows))] + [X[rows - k] for k in range(1, p + 1)])
        B, *_ = np.linalg.lstsq(Xm, X[rows], rcond=None)
        R = X[rows] - Xm @ B
        S = R.T @ R / len(rows)
        aic = np.linalg.slogdet(S)[1] + 2.0 * (p * K * K + K) / len(rows)
        assert abs(got[got.p == p].aic.iloc[0] - aic) < 1e-8


def test_walk_forward_equals_naive_refits(spark, filled, X):
    p, split = 2, 650
    wf = ln.walk_forward(filled, VARS, p, split=split, size=64).toPandas()
    assert len(wf) == (len(X) - split) * len(VARS)
    for t in (split, 700, len(X) - 1):
        rows = np.arange(p, t)
        Xm = np.column_stack([np.ones(len(rows))] + [X[rows - k] for k in range(1, p + 1)])
        B, *_ = np.linalg.lstsq(Xm, X[rows], rcond=None)
        pred = np.concatenate([[1.0]] + [X[t - k] for k in range(1, p + 1)]) @ B
        got = wf[wf.idx == t].set_index("variable").loc[VARS].predicted.to_numpy()
        assert np.max(np.abs(got - pred)) < 1e-8


def _adf_numpy(x):
    """Straight re-computation: lag by AIC on the common sample, refit, tau."""
    n = len(x)
    L = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    dx = np.diff(x)

    def design(lag, start):
        t = np.arange(start, n)                       # x index of the target dx_t = x_t - x_{t-1}
        cols = [np.ones(len(t)), x[t - 1]] + [dx[t - 1 - k] for k in range(1, lag + 1)]
        return np.column_stack(cols), dx[t - 1]

    best = None
    for lag in range(0, L + 1):
        Xm, y = design(lag, L + 1)
        ssr, _ = _ssr(y, Xm)
        m = len(y)
        aic = m * (np.log(2 * np.pi) + np.log(ssr / m) + 1) + 2 * Xm.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lag)
    lag = best[1]
    Xm, y = design(lag, lag + 1)
    ssr, b = _ssr(y, Xm)
    s2 = ssr / (len(y) - Xm.shape[1])
    inv = np.linalg.inv(Xm.T @ Xm)
    return b[1] / math.sqrt(s2 * inv[1, 1]), lag, len(y)


def test_adf_matches_numpy(spark, filled, X):
    got = ln.adf(dg.long_series(filled, VARS)).toPandas().set_index("variable")
    for i, c in enumerate(VARS):
        tau, lag, nobs = _adf_numpy(X[:, i])
        assert got.loc[c, "used_lag"] == lag and got.loc[c, "nobs"] == nobs
        assert abs(got.loc[c, "adf_stat"] - tau) < 1e-6
        assert abs(got.loc[c, "p_value"] - st.mackinnon_p(tau)) < 1e-12


def test_adf_random_walk_not_stationary(spark):
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(size=400))
    df = spark.createDataFrame(pd.DataFrame({"variable": "w", "idx": np.arange(400), "value": x}))
    r = ln.adf(df).first()
    assert r["p_value"] > 0.05 and not r["stationary"]


def test_pacf_is_yule_walker(spark, filled, X):
    a = dg.acf(dg.long_series(filled, VARS), nlags=8, alpha=None)
    p = dg.pacf(a).toPandas()
    x = X[:, 0] - X[:, 0].mean()
    n = len(x)
    r = np.array([x[k:] @ x[: n - k] for k in range(9)]) / (x @ x)
    for k in range(1, 9):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(R, r[1: k + 1])
        got = p[(p.variable == "click") & (p.lag == k)].pacf.iloc[0]
        assert abs(got - phi[-1]) < 1e-9


def _fisher_from_dft(x):
    """Fisher's g from a DFT matrix product with the two documented scalings:
    even length: squared cosine sums of frequencies 0 .. n/2 - 1 alone; odd
    length: the periodogram of frequencies 1 .. (n - 1)/2."""
    n = len(x)
    freq = np.arange(n // 2) if n % 2 == 0 else np.arange(1, (n + 1) // 2)
    z = np.exp(2j * np.pi * np.outer(freq, np.arange(1, n + 1)) / n) @ x
    power = z.real ** 2 / n if n % 2 == 0 else np.abs(z) ** 2 * 2 / n
    return power.max() / power.sum()


@pytest.mark.parametrize("n", [200, 201])
def test_fisher_both_branches(spark, n):
    rng = np.random.default_rng(n)
    x = np.sin(np.arange(n) / 3.0) + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"variable": "s", "idx": np.arange(n), "value": x}))
    got = dg.fisher_g(df, size=37).first()["g"]
    assert abs(got - _fisher_from_dft(x)) < 1e-9


def test_bh_correct_matches_numpy(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(size=40) ** 2
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(40), "p_value": p}))
    for size in (3, 65536):
        got = ln.bh_correct(df, size=size).toPandas().sort_values("i").q_value.to_numpy()
        assert np.allclose(got, st.bh_adjust(p))


def test_arma_recovers_planted_ar2(spark):
    rng = np.random.default_rng(11)
    n = 3000
    y = np.zeros(n)
    e = rng.normal(size=n)
    for t in range(2, n):
        y[t] = 0.6 * y[t - 1] - 0.3 * y[t - 2] + e[t]
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "value": y}))
    fit = ln.arima_fit(df, 2, 0, 0).toPandas().set_index("term").coef
    assert abs(fit["ar1"] - 0.6) < 0.05 and abs(fit["ar2"] + 0.3) < 0.05
    grid = ln.arma_grid(df, 4, 3).toPandas()
    best = grid.loc[grid.bic.idxmin()]
    assert (best.p, best.q) == (2, 0)


def test_granger_planted_edge(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.8 * x[t - 1] + 0.2 * rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "x": x, "y": y}))
    m = ln.granger_matrix(ln.granger(df, ["x", "y"], maxlag=3)).toPandas().set_index(["target", "source"])
    assert m.loc[("y", "x"), "p_value"] < 1e-6
    assert m.loc[("x", "y"), "p_value"] > 0.01


def test_pcmci_planted_links(spark):
    from chronoframe.operators.causality import parse_links, pcmci
    rng = np.random.default_rng(21)
    n = 2000
    x, y, w = rng.normal(size=n), np.zeros(n), rng.normal(size=n)
    for t in range(2, n):
        y[t] = 0.5 * y[t - 1] + 0.6 * x[t - 2] + 0.3 * rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "x": x, "y": y, "w": w}))
    links = pcmci(df, ["x", "y", "w"], tau_max=3).toPandas()
    sig = {(r.source, r.target, r.lag) for r in links.itertuples() if r.significant}
    assert ("x", "y", 2) in sig and ("y", "y", 1) in sig
    assert not any(s == "w" or t == "w" for s, t, _ in sig)
    assert not any(s == "y" and t == "x" for s, t, _ in sig)
    e = parse_links(pcmci(df, ["x", "y", "w"], tau_max=3)).toPandas().set_index(["source", "target"])
    assert bool(e.loc[("x", "y"), "edge"]) and not bool(e.loc[("y", "x"), "edge"])


@pytest.mark.parametrize("n,size", [(240, 64), (221, 64), (211, 64), (200, 16)])
def test_fisher_paths_agree_with_loops(spark, n, size):
    # 240 = 15 x 16 and 221 = 13 x 17 take the four-step FFT; 211 (prime) and
    # 200 with a small block (20 > 16 rows per group) take partial DFTs per block
    rng = np.random.default_rng(n)
    x = np.cos(np.arange(n) / 2.0) + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"variable": "s", "idx": np.arange(n), "value": x}))
    got = dg.fisher_g(df, size=size).first()
    assert abs(got["g"] - _fisher_from_dft(x)) < 1e-9
    assert got["n_freq"] == (n // 2 if n % 2 == 0 else (n - 1) // 2)


def test_sarima_forecast_planted_ar1_with_drift(spark):
    rng = np.random.default_rng(9)
    n = 1500
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = 0.5 * w[t - 1] + 1.0 + 0.1 * rng.normal()       # differenced series
    y = np.cumsum(w)                                           # integrated once
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "value": y}))
    coefs, fc = ln.sarima(df, (1, 1, 0), None, steps=5, trend="c")
    c = coefs.toPandas().set_index("term").coef
    assert abs(c["ar_L1"] - 0.5) < 0.05
    f = fc.toPandas().sort_values("idx")
    # exact recursion with the fitted coefficients
    ww, yy = w[-1], y[-1]
    exp = []
    for _ in range(5):
        ww = c["const"] + c["ar_L1"] * ww
        yy = yy + ww
        exp.append(yy)
    assert np.allclose(f["mean"].to_numpy(), exp, rtol=1e-9)
    widths = (f.upper - f.lower).to_numpy()
    assert np.all(np.diff(widths) > 0)


def test_seasonal_lag_sets():
    ar, ma, d, D, s = ln.sarima_lags((1, 0, 1), (1, 1, 1, 7))
    assert ar == [1, 7, 8] and ma == [1, 7, 8] and (d, D, s) == (0, 1, 7)


def test_walk_forward_many_series_equals_single(spark, filled, X):
    long = dg.long_series(filled, VARS).select(F.col("variable").alias("series"), "idx", F.col("value").alias("x"))
    many = ln.walk_forward(long, ["x"], 2, split=650, keys=["series"], size=32).toPandas()
    for i, c in enumerate(VARS[:2]):
        one = ln.walk_forward(filled.select("idx", F.col(c).alias("x")), ["x"], 2, split=650).toPandas()
        a = many[many.series == c].sort_values("idx").predicted.to_numpy()
        b = one.sort_values("idx").predicted.to_numpy()
        assert len(a) == len(b) == len(X) - 650 and np.allclose(a, b, atol=1e-8)


def test_granger_keyed_equals_per_series(spark, filled):
    two = filled.withColumn("s", F.lit("a")).unionByName(filled.withColumn("s", F.lit("b")))
    keyed = ln.granger(two, VARS[:3], maxlag=3, keys=["s"]).toPandas()
    single = ln.granger(filled, VARS[:3], maxlag=3).toPandas()
    for s_ in ("a", "b"):
        k = keyed[keyed.s == s_].sort_values(["target", "source", "lag"]).chi2.to_numpy(dtype=float)
        one = single.sort_values(["target", "source", "lag"]).chi2.to_numpy(dtype=float)
        assert np.allclose(k, one, equal_nan=True)


def test_configure_for_input(spark):
    from chronoframe.session import configure_for_input
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.files.maxPartitionBytes",
            "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
            "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.skewJoin.enabled"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        applied = configure_for_input(spark, 100 * 2 ** 40)
        assert int(applied["spark.sql.shuffle.partitions"]) == 409600
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_run_forecast_ar_integrated_equals_naive(spark):
    from chronoframe.operators.forecast import run_forecast
    rng = np.random.default_rng(13)
    n = 400
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = 0.6 * w[t - 1] + rng.normal()
    y = np.cumsum(w) + 100
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "y": y}))
    res = run_forecast(df, ["y"], "sarimax", split=300, order=(1, 1, 0), forecast_window=3, trend="c")
    pr = res["predictions"].toPandas().sort_values("idx")
    assert len(pr) == 100
    dw = np.diff(y)                                           # dw[j] = y[j+1] - y[j]
    for t in (300, 350, 399):
        j = t - 1                                             # index of w_t in dw
        rows = np.arange(1, j)                                # AR(1) on w with rows < j
        X = np.column_stack([np.ones(len(rows)), dw[rows - 1]])
        b, *_ = np.linalg.lstsq(X, dw[rows], rcond=None)
        pred = y[t - 1] + b[0] + b[1] * dw[j - 1]
        assert abs(pr[pr.idx == t].predicted.iloc[0] - pred) < 1e-8
    assert res["forecast"].count() == 3


def test_run_forecast_preconditions(spark, filled):
    from chronoframe.operators.forecast import run_forecast
    with pytest.raises(ValueError):
        run_forecast(filled, VARS[:1], "var", split=100)
    with pytest.raises(ValueError):
        run_forecast(filled, VARS[:2], "sarimax", split=100)
    with pytest.raises(ValueError):
        run_forecast(filled, VARS, "var", split=5)


def test_granger_pair_fanout_equals_single_task(spark, filled):
    a = ln.granger(filled, VARS, maxlag=4, fanout=False).toPandas().sort_values(["target", "source", "lag"])
    b = ln.granger(filled, VARS, maxlag=4, fanout=True).toPandas().sort_values(["target", "source", "lag"])
    assert len(a) == len(b) == 25 * 4
    assert np.allclose(a.chi2.to_numpy(dtype=float), b.chi2.to_numpy(dtype=float), equal_nan=True, rtol=1e-9)
    assert np.allclose(a.p_value.to_numpy(dtype=float), b.p_value.to_numpy(dtype=float), equal_nan=True)


def test_pcmci_target_fanout_equals_single_task(spark, filled):
    from chronoframe.operators.causality import pcmci
    a = pcmci(filled, VARS, tau_max=3, fanout=False).toPandas().sort_values(["source", "target", "lag"])
    b = pcmci(filled, VARS, tau_max=3, fanout=True).toPandas().sort_values(["source", "target", "lag"])
    assert len(a) == len(b)
    assert np.allclose(a.val.to_numpy(), b.val.to_numpy(), equal_nan=True, atol=1e-12)
    assert (a.significant.to_numpy() == b.significant.to_numpy()).all()


def test_differenced_models_have_no_constant_by_default(spark):
    rng = np.random.default_rng(3)
    y = np.cumsum(0.5 + rng.normal(size=600))
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(600), "value": y}))
    coefs, fc = ln.sarima(df, (1, 1, 0), None, steps=40)
    assert "const" not in [r.term for r in coefs.collect()]
    last = fc.orderBy("idx").collect()
    assert abs(last[-1]["mean"] - last[10]["mean"]) < 0.5      # no drift
    assert "const" not in [r.term for r in ln.arima_fit(df, 1, 1, 0).collect()]
    assert "const" in [r.term for r in ln.arima_fit(df, 1, 0, 0).collect()]


def test_refit_at_every_step_with_ma_terms(spark):
    """The regression on value and innovation lags is fitted to the rows before
    each test row; the innovations come from the training rows' long AR."""
    rng = np.random.default_rng(4)
    n, split = 300, 260
    e = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.5 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "value": y}))
    got = ln.sarima_one_step(df, (1, 0, 1), None, split, size=64).toPandas().set_index("idx").predicted
    m = ln._hr_initial_order(n, 1, 1)
    lags = np.column_stack([np.ones(n - m), *[y[m - k:n - k] for k in range(1, m + 1)]])
    beta, *_ = np.linalg.lstsq(lags[:split - m], y[m:split], rcond=None)
    res = np.full(n, np.nan)
    res[m:] = y[m:] - lags @ beta
    for t in (260, 275, 299):
        rows = np.arange(m + 1, t)
        b, *_ = np.linalg.lstsq(np.column_stack([y[rows - 1], res[rows - 1]]), y[rows], rcond=None)
        assert got[t] == pytest.approx(b @ [y[t - 1], res[t - 1]], abs=1e-7)

"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole input tables.  Doubles are rounded to 6 decimals for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as dg
from ..operators import impute as im
from ..operators import missing as ms
from ..operators import transform as tf
from ..operators.ordering import dense_index, lagged
from ..operators.spline import spline_interpolate
from ..session import cut_lineage
from . import fixtures as fx

VARS = fx.HOURLY_VARS


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison.  A nudge of 1e-9 away from zero makes
    exact ties (frequent after interpolation) round the same way in every
    engine, whatever its tie rule and last-ulp differences."""
    def rnd(c):
        x = F.col(c)
        # + 0.0 turns a -0.0 into 0.0 (engines differ on the sign of a rounded zero)
        return (F.round(x + F.signum(x) * F.lit(1e-9), digits) + F.lit(0.0)).alias(c)
    return df.select(*[rnd(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def hourly_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly series with gaps carried forward, then leading gaps backward."""
    h = fx.ts_hourly(spark, sf, materialize=False).drop("t")
    return cut_lineage(im.locf(h, VARS, "idx", subject=None, nocb=True))


def hourly_diff_long(spark, sf, order: int = 1) -> DataFrame:
    d = tf.difference(hourly_filled(spark, sf), VARS, order=order, check=False)
    return dg.long_series(d, VARS)


# ------------------------------------------------------------------ flagship

def flagship_diff_acf(spark: SparkSession, sf: str) -> DataFrame:
    """events -> hourly mean per type -> carry forward/backward -> first
    difference -> ACF (lags 0..min(50, n//2-1)) with Bartlett band."""
    return r6(dg.acf(hourly_diff_long(spark, sf)))


# ------------------------------------------------------- sources / missing

def hourly_resample(spark, sf):
    return r6(fx.ts_hourly(spark, sf).drop("t"))


def daily_series(spark, sf):
    return r6(fx.ts_daily(spark, sf).select("idx", "total", "n"))


def hourly_missing_profile(spark, sf):
    return r6(ms.missing_profile(fx.ts_hourly(spark, sf), VARS))


def ld_missing_profile(spark, sf):
    return r6(ms.missing_profile(fx.ld_events(spark, sf), ["event_type", "value", "k"]))


def missing_indices(spark, sf):
    return ms.missing_indices(fx.ts_hourly(spark, sf), VARS)


def column_summary(spark, sf):
    li = fx.wide_lineitem(spark, sf)
    return r6(ms.column_summary(li, li.columns))


def subject_missing(spark, sf):
    return ms.subject_missing(fx.ld_events(spark, sf), "user_id", ["event_type", "value"])


# -------------------------------------------------------------- imputation

def locf(spark, sf):
    e = fx.ld_events(spark, sf)
    return r6(im.locf(e, ["event_type", "value"], "visit", "user_id").select(
        "user_id", "visit", "event_type", "value"))


def locf_nocb(spark, sf):
    e = fx.ld_events(spark, sf)
    return r6(im.locf(e, ["event_type", "value"], "visit", "user_id", nocb=True).select(
        "user_id", "visit", "event_type", "value"))


def nearest_mean(spark, sf):
    return r6(im.nearest_mean(fx.ts_hourly(spark, sf).drop("t"), VARS, n=2))


def linear_interpolate(spark, sf):
    return r6(im.interpolate(fx.ts_hourly(spark, sf).drop("t"), VARS, order=1))


def spline_hourly(spark, sf):
    """Gaps of the hourly series by the global cubic spline of each variable."""
    return r6(spline_interpolate(fx.ts_hourly(spark, sf).drop("t"), VARS, order=3))


def ld_spline(spark, sf):
    """Missing event values by each subject's global quadratic spline over its visits."""
    ev = fx.ld_events(spark, sf).select("user_id", "visit", "value")
    return r6(spline_interpolate(ev, ["value"], order=2, idx="visit", keys=["user_id"]))


def imputation_sets(spark, sf):
    return r6(im.imputation_sets(fx.ts_hourly(spark, sf), ["click"], ar_lag=3))


# -------------------------------------------------------------- transforms

def difference2(spark, sf):
    return r6(tf.difference(hourly_filled(spark, sf), VARS, order=2))


def reverse_difference(spark, sf):
    """Second difference of the filled ``click`` series undone from its two
    seeds (first value, first difference): the round trip gives the series back."""
    f = hourly_filled(spark, sf).select("idx", "click")
    seeds = f.where(F.col("idx") <= 1).orderBy("idx").collect()      # two scalars
    x0, x1 = seeds[0]["click"], seeds[1]["click"]
    d2 = tf.difference(f, ["click"], order=2, check=False)
    return r6(tf.reverse_difference(d2, "click", [x0, x1 - x0]))


def minmax_scale(spark, sf):
    return r6(tf.minmax_scale(hourly_filled(spark, sf), VARS)[0])


def bin_equal_width(spark, sf):
    li = fx.wide_lineitem(spark, sf)
    binned, edges = tf.bin_equal_width(li, "l_extendedprice", 10, out="code")
    lo = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("code") + 1)
    hi = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("code") + 2)
    return r6(binned.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.min("l_extendedprice").alias("min_value"),
                                         F.max("l_extendedprice").alias("max_value"))
              .select("code", "n_rows", "min_value", "max_value", lo.alias("edge_lo"), hi.alias("edge_hi")))


def label_encode(spark, sf):
    e = fx.ld_events(spark, sf)
    enc, _ = tf.label_encode(e, "event_type", out="code")
    # the encoded column holds NULLs: float, as the reference's encoded series with NaN
    return enc.select("user_id", "visit", "event_type", F.col("code").cast("double").alias("code"))


def one_hot(spark, sf):
    c = fx.ld_conversations(spark, sf)
    out, _ = tf.one_hot(c.select("conv_id", "turn", "role"), "role")
    return out


def subject_windows(spark, sf):
    e = fx.ld_events(spark, sf)
    return r6(tf.subject_windows(e, "user_id", "visit", ["value"], None, window=3).select(
        "user_id", "visit", "value", "value_lag1", "value_lag2"))


def supervised_windows(spark, sf):
    d = fx.ts_daily(spark, sf).select("idx", "total")
    n = d.count()
    split = int(0.8 * (n - 2))
    return r6(tf.supervised_windows(d, ["total"], order=3, horizon=2, split=split, val=0))


def temporal_split(spark, sf):
    d = fx.ts_daily(spark, sf).select("idx", "total")
    split = int(0.8 * d.count())
    s = tf.temporal_split(d, split)
    # a sum near 1e9 carries no stable 6th decimal across engines: money to cents
    return r6(s.groupBy("set").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total").alias("total"),
                                   F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")), 2)


def subject_split(spark, sf):
    """Hold out the last fifth of the subjects in id order."""
    e = fx.ld_events(spark, sf)
    subj = ms.subjects(e, "user_id")
    ranked = dense_index(subj, ["user_id"], idx="r")
    n = subj.count()
    test = ranked.where(F.col("r") >= F.lit(int(n - n // 5)))
    return tf.subject_split(e, "user_id", test).select("user_id", "visit", "set")


# ------------------------------------------------------------- diagnostics

def acf_bartlett(spark, sf):
    return r6(dg.acf(dg.long_series(hourly_filled(spark, sf), VARS)))


def seasonal_decompose(spark, sf):
    return r6(dg.seasonal_decompose(dg.long_series(hourly_filled(spark, sf), VARS), period=3))


def fisher_g(spark, sf):
    return r6(dg.fisher_g(dg.long_series(hourly_filled(spark, sf), VARS)))


def durbin_watson(spark, sf):
    return r6(dg.durbin_watson(hourly_diff_long(spark, sf)))


def residual_histogram(spark, sf):
    return r6(dg.histogram(hourly_diff_long(spark, sf), bins=10))


def mae_naive(spark, sf):
    """Naive one-step forecast x_t = x_{t-1} on the last fifth of the hours."""
    f = hourly_filled(spark, sf)
    n = f.count()
    split = int(0.8 * n)
    lg = lagged(dg.long_series(f, VARS), ["value"], lags=[1], keys=[dg.V])
    test = lg.where(F.col("idx") >= split).select(dg.V, F.col("value").alias("observed"),
                                                 F.col("value_lag1").alias("predicted"))
    return r6(dg.mae(test))


def overlap_average(spark, sf):
    """Row i predicts i+1..i+h (here the naive forecast x_i for every
    step); predictions of the same target step are averaged."""
    from ..operators.results import overlap_average as ova
    d = fx.ts_daily(spark, sf).select("idx", "total")
    h = 3
    preds = d.select("idx", F.array(*[F.col("total")] * h).alias("pred"))
    return r6(ova(preds, "idx", "pred", variable="total"))


# ------------------------------------------------- numeric (checked in tests/)

def _filled_cached(spark, sf):
    return hourly_filled(spark, sf)


def pacf(spark, sf):
    a = dg.acf(dg.long_series(hourly_filled(spark, sf), VARS), alpha=None)
    return r6(dg.pacf(a))


def adf(spark, sf):
    from ..operators.linear import adf as _adf
    return r6(_adf(dg.long_series(hourly_filled(spark, sf), VARS)))


def stationarity(spark, sf):
    from ..operators.linear import adf as _adf, stationarity as _st
    return r6(_st(_adf(dg.long_series(hourly_filled(spark, sf), VARS))))


def granger_tests(spark, sf):
    """All ordered pairs x lags 1..10 on the differenced hourly series."""
    from ..operators.linear import granger
    d = tf.difference(hourly_filled(spark, sf), VARS, order=1, check=False)
    return r6(granger(d, VARS, maxlag=10))


def granger_network(spark, sf):
    """Min-p matrix, BH-adjusted over the off-diagonal family, edges at 0.05."""
    from ..operators.linear import bh_correct, filter_causality, granger, granger_matrix
    d = tf.difference(hourly_filled(spark, sf), VARS, order=1, check=False)
    m = granger_matrix(granger(d, VARS, maxlag=10))
    m = bh_correct(m.where(F.col("target") != F.col("source")), "p_value")
    return r6(filter_causality(m))


def var_fit(spark, sf):
    """VAR(4) on the five hourly variables (constant included)."""
    from ..operators.linear import var_fit as _vf
    return r6(_vf(hourly_filled(spark, sf), VARS, 4))


def var_select_order(spark, sf):
    from ..operators.linear import var_select_order as _vs
    return r6(_vs(hourly_filled(spark, sf), VARS, 12))


def var_param_minima(spark, sf):
    """AIC/BIC for p = 0..8 on own samples, running strict minima over p < 8."""
    from ..operators.linear import var_param_search
    from ..operators.results import running_minima
    g = var_param_search(hourly_filled(spark, sf), VARS, 8).where(F.col("p") < 8)
    return r6(running_minima(g.select("p", "aic", "bic"), ["aic", "bic"], [F.col("p")]))


def var_walk_forward(spark, sf):
    """VAR(2) one-step walk-forward over the last fifth of the hours."""
    from ..operators.linear import walk_forward
    f = hourly_filled(spark, sf)
    n = f.count()
    return r6(walk_forward(f, VARS, 2, split=int(0.8 * n)))


def ar_walk_forward(spark, sf):
    """AR(5) one-step walk-forward on the daily order totals (last fifth)."""
    from ..operators.linear import walk_forward
    d = fx.ts_daily(spark, sf).select("idx", "total")
    n = d.count()
    return r6(walk_forward(d, ["total"], 5, split=int(0.8 * n)))


def var_forecast(spark, sf):
    """VAR(2) 24-step forecast with 95 % interval."""
    from ..operators.linear import var_fit as _vf, var_forecast as _vfc
    f = hourly_filled(spark, sf)
    return r6(_vfc(f, VARS, _vf(f, VARS, 2), 2, 24))


def ljung_box(spark, sf):
    """Ljung-Box on the VAR(2) residuals, lags 1..10."""
    from ..operators.linear import var_fit as _vf, var_residuals
    f = hourly_filled(spark, sf)
    res = var_residuals(f, VARS, _vf(f, VARS, 2), 2)
    a = dg.acf(res, nlags=10, alpha=None)
    n = res.groupBy(dg.V).agg(F.count(F.lit(1)).alias("n"))
    return r6(dg.ljung_box(a, n, lags=10))


def leaderboard(spark, sf):
    """MAE of the VAR(2) walk-forward and the Ljung-Box verdict on its residuals."""
    from ..operators.linear import walk_forward
    from ..operators.results import leaderboard as _lb
    f = hourly_filled(spark, sf)
    n = f.count()
    wf = walk_forward(f, VARS, 2, split=int(0.8 * n))
    m = dg.mae(wf).withColumn("model", F.lit("VAR(2)"))
    res = wf.select(dg.V, (F.col("idx") - F.lit(int(0.8 * n))).alias("idx"), F.col("residual").alias("value"))
    a = dg.acf(res, nlags=10, alpha=None)
    lb = dg.ljung_box(a, res.groupBy(dg.V).agg(F.count(F.lit(1)).alias("n")), lags=10)
    share = dg.ljung_box_share(lb).withColumn("model", F.lit("VAR(2)"))
    return r6(_lb(m, share))


def arima_fit(spark, sf):
    """ARIMA(2,1,1) on the daily order totals (Hannan-Rissanen)."""
    from ..operators.linear import arima_fit as _af
    d = fx.ts_daily(spark, sf).select("idx", F.col("total").alias("value"))
    return r6(_af(d, 2, 1, 1))


def arma_grid_minima(spark, sf):
    """AIC/AICc/BIC grid for p, q < 4 on the differenced daily
    totals and the successive minima along the anti-diagonal walk."""
    from ..operators.linear import arma_grid
    from ..operators.results import running_minima, walk_order
    d = fx.ts_daily(spark, sf).select("idx", F.col("total").alias("value"))
    d1 = tf.difference(d, ["value"], order=1, check=False)
    g = arma_grid(d1, 4, 4)
    return r6(running_minima(g.select("p", "q", "aic", "aicc", "bic"), ["aic", "aicc", "bic"], [walk_order(4, 4)]))


def box_cox(spark, sf):
    """Variance-stabilising power transform of the daily totals (lambda by ML)."""
    from ..operators.power import stabilize_variance
    d = fx.ts_daily(spark, sf).select("idx", "total")
    out, lam = stabilize_variance(d, "total")
    return r6(out.withColumn("lambda", F.lit(lam)))


# ------------------------------------------------------------ learned models

def model_impute(spark, sf):
    """I4: AR(3) regression imputation of the hourly ``click`` series."""
    from ..operators.learn import model_impute as _mi
    h = fx.ts_hourly(spark, sf).select("idx", "click")
    return r6(_mi(h, "click", ar_lag=3))


def chained_impute(spark, sf):
    """I8: chained ridge equations over value and k of the longitudinal events."""
    from ..operators.learn import chained_impute as _ci
    e = fx.ld_events(spark, sf).select("user_id", "visit", "event_id", "value", "k")
    return r6(_ci(e, ["value", "k"], max_iter=10))


def forest_impute(spark, sf):
    """Forest imputation of value (numeric) and event_type (categorical) with k."""
    from ..operators.learn import forest_impute as _fi
    e = fx.ld_events(spark, sf).select("user_id", "visit", "event_id", "event_type", "value", "k")
    return r6(_fi(e, ["event_type", "value", "k"], categorical=["event_type"]))


def window_regression(spark, sf):
    """Windowed regression (order 3, horizon 2) on the hourly series, split at 80 %."""
    from ..operators.learn import window_regression as _wr
    f = hourly_filled(spark, sf)
    n = f.count()
    pred, _, _, _ = _wr(f, VARS, order=3, horizon=2, split=int(0.8 * n), outputs=["click", "view"])
    return r6(pred)


def nn_forecast(spark, sf):
    """Recursive 24-step forecast with 2-step multi-output models, a
    5-model bagged ensemble and the draw interval averaged over overlaps."""
    from ..operators.learn import forecast_recursive
    return r6(forecast_recursive(hourly_filled(spark, sf), VARS, order=3, steps=24, draws=5, horizon=2))


def window_classifier(spark, sf):
    """Next role of a conversation turn from windows of message lengths; last fifth of conversations held out."""
    from ..operators.learn import window_classifier as _wc
    c = fx.ld_conversations(spark, sf)
    convs = c.select("conv_id").distinct()
    ranked = dense_index(convs, ["conv_id"], idx="r")
    n = convs.count()
    test = ranked.where(F.col("r") >= F.lit(int(n - n // 5)))
    return r6(_wc(c, "conv_id", "turn", ["n_chars"], "role", window=3, test_subjects=test))


def _dynamic(spark, sf):
    """Next event type per user from one-hot history (delay 3, decay 0.5); the
    last fifth of the users is held out.  An event without a type is a step
    without inputs, and no target."""
    from ..operators.learn import dynamic_classifier as _dc
    e = fx.ld_events(spark, sf).select("user_id", "visit", "event_type")
    users = dense_index(e.select("user_id").distinct(), ["user_id"], idx="r")
    n = users.count()
    held = users.where(F.col("r") >= F.lit(int(n - n // 5))).select("user_id")
    return _dc(e, "user_id", "visit", ["event_type"], "event_type", delay=3, decay=0.5, test_subjects=held)


def dynamic_classifier(spark, sf):
    """Recall on the training and the held-out users."""
    return r6(_dynamic(spark, sf)[0])


def dynamic_groups(spark, sf):
    """Per user, the most frequent predicted and actual event type."""
    return r6(_dynamic(spark, sf)[1])


def dynamic_weights(spark, sf):
    """Weights per output and input, averaged over the lags."""
    return r6(_dynamic(spark, sf)[2])


def rbm_structure(spark, sf):
    """RBM weights over the encoded attributes of all documents (lang,
    source, quality, toxic); an attribute that is missing has a level of its own."""
    from ..operators.learn import rbm_structure as _rbm
    cols = ["lang", "source", "quality", "toxic"]
    d = fx.ml_docs(spark, sf, how="left").select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("~missing")).alias(c) for c in cols])
    enc, _ = tf.encode_for_rbm(d, cols, keep=["doc_id"])
    return r6(_rbm(enc, n_hidden=4, n_iter=10, learning_rate=0.1, row_id="doc_id"))


# ---------------------------------------------------------------- sources

def csv_roundtrip(spark, sf):
    """The hourly series exported as ';'-separated CSV into the
    shared scratch folder, read back with delimiter inference and file-order
    index: equals the series."""
    from ..sources.csv import export_series, read_series, scratch_dir
    h = fx.ts_hourly(spark, sf).drop("t")
    path = scratch_dir(spark, "csv-roundtrip")
    export_series(h, path, cols=VARS, order_by=("idx",), sep=";")
    back = read_series(spark, path)
    return r6(back.select("idx", *[F.col(c).cast("double").alias(c) for c in VARS]))


def ld_csv_roundtrip(spark, sf):
    """S3: longitudinal events written as CSV (subject first) and read back
    with per-subject visit numbering from the file order."""
    from ..sources.csv import export_series, read_longitudinal, scratch_dir
    e = fx.ld_events(spark, sf).select("user_id", "visit", "event_type", "value", "k")
    path = scratch_dir(spark, "ld-roundtrip")
    export_series(e, path, cols=["user_id", "event_type", "value", "k"], order_by=("user_id", "visit"))
    back = read_longitudinal(spark, path, sep=",")
    return r6(back.select(F.col("user_id").cast("long").alias("user_id"), "visit", "event_type",
                          F.col("value").cast("double").alias("value"), F.col("k").cast("long").alias("k")))


def pcmci(spark, sf):
    """PCMCI (ParCorr, tau_max 8, automatic pc_alpha, BH over lagged
    links, alpha 0.01) on the differenced hourly series; links per lag."""
    from ..operators.causality import pcmci as _pc
    d = tf.difference(hourly_filled(spark, sf), VARS, order=1, check=False)
    return r6(_pc(d, VARS, tau_max=8))


def imputation_check(spark, sf):
    """M10 + I1/I2 + D12: blank 24 known hours of the filled series
    (deterministic hash order), impute them by neighbour mean and by linear
    interpolation, and report the MAE against the blanked truth."""
    f = hourly_filled(spark, sf)
    blanked = ms.inject_missing(f, VARS, 24, seed=7)
    truth = dg.long_series(f, VARS).withColumnRenamed("value", "observed")
    holes = dg.long_series(blanked, VARS).where(F.col("value").isNull()).select(dg.V, "idx")
    out = None
    for name, imp in (("nearest_mean", im.nearest_mean(blanked, VARS, n=2)),
                      ("linear", im.interpolate(blanked, VARS, order=1))):
        got = dg.long_series(imp, VARS).withColumnRenamed("value", "predicted")
        m = holes.join(got, [dg.V, "idx"]).join(truth, [dg.V, "idx"])
        m = dg.mae(m).withColumn("method", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return r6(out)


def arima_forecast(spark, sf):
    """ARIMA(2,1,1) on the daily order totals, 30-step forecast with 95 % interval."""
    from ..operators.linear import sarima
    d = fx.ts_daily(spark, sf).select("idx", F.col("total").alias("value"))
    _, fc = sarima(d, (2, 1, 1), None, steps=30)
    return r6(fc)


def sarima_fit(spark, sf):
    """seasonal order (1,0,1,7) (weekly) with the default AR(1) part on the daily totals."""
    from ..operators.linear import sarima
    d = fx.ts_daily(spark, sf).select("idx", F.col("total").alias("value"))
    coefs, _ = sarima(d, (0, 0, 0), (1, 0, 1, 7))
    return r6(coefs)


def rbm_encode(spark, sf):
    """Document attributes encoded for the RBM: lang and source one-hot
    (sorted levels), quality and toxic as 0/1 labels."""
    d = fx.ml_docs(spark, sf).select("doc_id", "lang", "source", "quality", "toxic")
    enc, _ = tf.encode_for_rbm(d, ["lang", "source", "quality", "toxic"], keep=["doc_id"])
    return r6(enc)


def replace_values(spark, sf):
    """Find-and-replace in one column (k = 42 -> -1) of the longitudinal events."""
    e = fx.ld_events(spark, sf).select("user_id", "visit", "k")
    return tf.replace_values(e, "k", 42, -1)


def subjects(spark, sf):
    """Distinct subject ids."""
    return ms.subjects(fx.ld_events(spark, sf), "user_id")


def granger_by_variable(spark, sf):
    """Sources that Granger-cause ``view`` at p < 0.05 (ascending), differenced hourly series."""
    from ..operators.linear import granger, granger_by_variable as _gbv
    d = tf.difference(hourly_filled(spark, sf), VARS, order=1, check=False)
    return r6(_gbv(granger(d, VARS, maxlag=10, pairs=[("view", s) for s in VARS]), "view"))


def segment_walk_forward(spark, sf):
    """F5 over many series: AR(3) one-step walk-forward of the daily order
    total of every market segment (orders x customer), last fifth predicted;
    MAE per segment."""
    from ..operators.linear import walk_forward
    seg = fx.ts_segment(spark, sf).select("segment", "idx", "total")
    wf = walk_forward(seg, ["total"], 3, split=0.8, keys=["segment"])
    return r6(dg.mae(wf, keys=["segment", dg.V]).join(
        wf.groupBy("segment").agg(F.count(F.lit(1)).alias("n_predicted")), "segment"))


# ------------------------------------------------- keyed (many-series) forms

def ld_nearest_mean(spark, sf):
    """I1 per subject: neighbour mean (n = 2) of value within each user's visits."""
    e = fx.ld_events(spark, sf).select("user_id", "visit", "value")
    return r6(im.nearest_mean(e, ["value"], n=2, idx="visit", keys=["user_id"]))


def ld_difference(spark, sf):
    """T1 per subject: first difference of k within each user's visits."""
    e = fx.ld_events(spark, sf).select("user_id", "visit", "k")
    return tf.difference(e, ["k"], order=1, idx="visit", keys=["user_id"])


def ld_acf(spark, sf):
    """D1 per subject: ACF of k for every user (lags up to min(50, n_user//2 - 1)) with Bartlett band."""
    e = fx.ld_events(spark, sf).select("user_id", F.col("visit").alias("idx"), F.col("k").cast("double").alias("value"))
    return r6(dg.acf(e.withColumn(dg.V, F.lit("k")), keys=["user_id"]))


def seasonal_decompose_mult(spark, sf):
    """D4 multiplicative with an even period (4: 2 x MA trend) on the filled hourly series."""
    return r6(dg.seasonal_decompose(dg.long_series(hourly_filled(spark, sf), VARS), period=4, model="multiplicative"))


def ld_interpolate(spark, sf):
    """I2 per subject: linear interpolation of value within each user's visits
    (leading gap stays missing, trailing gap extrapolated from the last two)."""
    e = fx.ld_events(spark, sf).select("user_id", "visit", "value")
    return r6(im.interpolate(e, ["value"], order=1, idx="visit", keys=["user_id"]))


def forecast_table(spark, sf):
    """VAR(2) 24-step forecast as one row per step with lower and upper columns."""
    from ..operators.linear import var_fit as _vf, var_forecast as _vfc
    from ..operators.results import forecast_wide
    f = hourly_filled(spark, sf)
    return r6(forecast_wide(_vfc(f, VARS, _vf(f, VARS, 2), 2, 24), VARS))


def sarimax_process(spark, sf):
    """ARIMA(2,1,1) on the daily totals: one-step predictions on the
    last fifth (parameters from the training rows), errors, 14-step forecast."""
    from ..operators.forecast import run_forecast
    d = fx.ts_daily(spark, sf).select("idx", "total")
    n = d.count()
    res = run_forecast(d, ["total"], "sarimax", split=int(0.8 * n), order=(2, 1, 1), forecast_window=14)
    return r6(res["errors"].join(res["predictions"].groupBy(dg.V).agg(F.count(F.lit(1)).alias("n_predicted")), dg.V))


def var_process(spark, sf):
    """VAR(2) walk-forward over the last fifth of the hours, errors and a 12-step forecast."""
    from ..operators.forecast import run_forecast
    f = hourly_filled(spark, sf)
    n = f.count()
    res = run_forecast(f, VARS, "var", split=int(0.8 * n), p=2, forecast_window=12)
    return r6(res["forecast"].join(res["errors"], dg.V))


def ljung_box_naive(spark, sf):
    """Ljung-Box Q and chi^2 p-values (lags 1..10) of the naive-model
    residuals (first difference of the filled hourly series)."""
    res = hourly_diff_long(spark, sf)
    a = dg.acf(res, nlags=10, alpha=None)
    n = res.groupBy(dg.V).agg(F.count(F.lit(1)).alias("n"))
    return r6(dg.ljung_box(a, n, lags=10))


def bh_ljung_box(spark, sf):
    """Benjamini-Hochberg adjusted Ljung-Box p-values over the family of
    all variables and lags (naive-model residuals of the hourly series)."""
    from ..operators.linear import bh_correct
    res = hourly_diff_long(spark, sf)
    a = dg.acf(res, nlags=10, alpha=None)
    n = res.groupBy(dg.V).agg(F.count(F.lit(1)).alias("n"))
    lb = dg.ljung_box(a, n, lags=10)
    return r6(bh_correct(lb.select(dg.V, "lag", "p_value")))


# ----------------------------------------- single operators, each with its SQL

def big_key_index(spark, sf):
    """Dense index per key for keys beyond 2^53 (neighbours that a double cannot
    tell apart) and a NULL key."""
    e = fx.read_table(spark, sf, "events", ["event_id", "user_id"]).select(
        "event_id", F.when(F.col("event_id") % 13 != 0, F.col("user_id") + F.lit(9007199254740992)).alias("key"))
    # the key as text: a comparison by way of doubles would not see the difference
    return dense_index(e, ["event_id"], keys=["key"], idx="pos").withColumn("key", F.col("key").cast("string"))


def one_hot_levels(spark, sf):
    """T8/T9 with any number of levels: position of every line item's part and
    order status flag in the one-hot vectors."""
    li = fx.read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])
    li = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"),
                   F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("part"), F.col("l_returnflag").alias("flag"))
    return tf.one_hot_sparse(li, ["part", "flag"], "row")


def adf_users(spark, sf):
    """D5 with lag 0 on every user's value series, whatever its length."""
    from ..operators.linear import adf as _adf
    e = fx.ld_events(spark, sf).select("user_id", "visit", F.coalesce("value", F.lit(0.0)).alias("value"))
    return r6(_adf(e, idx="visit", keys=["user_id"], maxlag=0).select("user_id", "adf_stat", "used_lag", "nobs"))


def granger_lag1(spark, sf):
    """C1 at lag 1 for every ordered pair of the differenced hourly series."""
    from ..operators.linear import granger
    d = tf.difference(hourly_filled(spark, sf), VARS, order=1, check=False)
    out = granger(d, VARS, maxlag=1).where(F.col("target") != F.col("source"))
    return r6(out.select("target", "source", "chi2"))


def segment_ar1(spark, sf):
    """F5 per segment: AR(1) one-step forecasts of the last fifth of each
    segment's own days."""
    from ..operators.linear import walk_forward
    seg = fx.ts_segment(spark, sf).select("segment", "idx", "total")
    return r6(walk_forward(seg, ["total"], 1, split=0.8, keys=["segment"]).drop("variable"), 4)


def active_customers(spark, sf):
    """Events of the users who are customers with an order."""
    e = fx.read_table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    o = fx.read_table(spark, sf, "orders", ["o_custkey"]).select(F.col("o_custkey").alias("user_id"))
    return ms.get_subject(e, "user_id", None, subjects_df=o)


def csv_names(spark, sf):
    """S5 on file names derived from the documents' sources."""
    from ..sources.csv import valid_source
    d = fx.read_table(spark, sf, "documents", ["doc_id", "source"])
    name = F.concat(F.lit("dir.d/"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, ".csv").when(
        F.col("doc_id") % 3 == 1, ".tar.csv").otherwise(".txt"))
    return valid_source(d.select("doc_id", name.alias("path")))


def minmax_roundtrip(spark, sf):
    """Scaled to (-1, 1) and back."""
    f = hourly_filled(spark, sf)
    scaled, ranges = tf.minmax_scale(f, VARS)
    return r6(tf.minmax_inverse(scaled, ranges))


def acf_display(spark, sf):
    """D3: the ACF with its display band."""
    return r6(dg.plot_bands(dg.acf(hourly_diff_long(spark, sf), alpha=None)).drop("band"))


def naive_residuals(spark, sf):
    """Observed minus the previous value."""
    long = dg.long_series(hourly_filled(spark, sf), VARS)
    pred = long.select(dg.V, (F.col("idx") + 1).alias("idx"), F.col("value").alias("predicted"))
    return r6(dg.residuals(long, pred))


def accepted_imputation(spark, sf):
    """Carried-forward values accepted into the visits where a user has one."""
    e = fx.ld_events(spark, sf).select("user_id", "visit", "value", "k")
    return r6(im.apply_imputation(e, im.locf(e, ["value"], "visit", "user_id"), ["value"], idx="visit", keys=["user_id"]))


def drop_sparse_columns(spark, sf):
    """Columns with more than a tenth of their values missing go."""
    e = fx.ld_events(spark, sf).select("user_id", "visit", "event_type", "value", "k")
    return ms.drop_high_missing(e, "user_id", threshold=0.1)


def incomplete_columns(spark, sf):
    """M3: columns with a missing value."""
    e = fx.ld_events(spark, sf)
    return ms.missing_columns(e, ["event_type", "value", "k"])


def event_value_bands(spark, sf):
    """Mean and two standard deviations of the values per event type."""
    from ..operators.results import draw_interval
    return r6(draw_interval(fx.read_table(spark, sf, "events", ["event_type", "value"]), ["event_type"]))


def record_lows(spark, sf):
    """days that set a new low of order total or order count per market segment."""
    from ..operators.results import running_minima
    d = fx.ts_segment(spark, sf).select("segment", "idx", "total")
    return r6(running_minima(d, ["total"], ["idx"], keys=["segment"]).select("segment", "criterion", "idx", "value"))


def observed_and_predicted(spark, sf):
    """tagged rows of the series and its previous-value prediction."""
    from ..operators.results import forecast_plot_table
    long = dg.long_series(hourly_filled(spark, sf), VARS)
    pred = long.select(dg.V, (F.col("idx") + 1).alias("idx"), F.col("value").alias("predicted"))
    return r6(forecast_plot_table(long, pred, None))


def transposed_days(spark, sf):
    """The daily table with every day a series, in long form."""
    from ..sources.csv import transpose_series
    return r6(transpose_series(fx.ts_daily(spark, sf).select("idx", "total", "n")))


# ---------------------------------------------------------- many series at once

def user_values(spark, sf) -> DataFrame:
    """Event values per user and visit, missing ones carried forward, then backward."""
    ev = fx.ld_events(spark, sf).select("user_id", "visit", "value")
    return cut_lineage(im.locf(ev, ["value"], "visit", "user_id", nocb=True).where("value IS NOT NULL").select(
        "user_id", F.col("visit").alias("idx"), "value"))


def user_ar1_forecast(spark, sf):
    """F1/F6 per user: AR(1) without a constant, three steps ahead with 95 % interval."""
    from ..operators.many_series import arima_many
    return r6(arima_many(user_values(spark, sf), (1, 0, 0), steps=3, keys=["user_id"])[1], 4)


def user_arma_fit(spark, sf):
    """F1/F4 per user: ARMA(1, 1) coefficients and criteria."""
    from ..operators.many_series import arima_many
    return r6(arima_many(user_values(spark, sf), (1, 0, 1), keys=["user_id"])[0])


def segment_seasonal_grid(spark, sf):
    """F7 with a period: seasonal orders (p, 0, q, 7), p, q < 2, of every market
    segment's daily totals."""
    from ..operators.many_series import arima_grid
    seg = fx.ts_segment(spark, sf).select("segment", "idx", F.col("total").alias("value"))
    return r6(arima_grid(seg, 2, 2, s=7, keys=["segment"]))


def segment_sarima_forecast(spark, sf):
    """F3/F6 per segment: ARIMA(1, 1, 1)(1, 0, 0, 7), ten days ahead."""
    from ..operators.many_series import arima_many
    seg = fx.ts_segment(spark, sf).select("segment", "idx", F.col("total").alias("value"))
    return r6(arima_many(seg, (1, 1, 1), (1, 0, 0, 7), steps=10, keys=["segment"])[1])


def segment_var_forecast(spark, sf):
    """F12 per segment: VAR(2) of daily total and its change, five days ahead."""
    from ..operators.linear import var_fit as _vf, var_forecast as _vfc
    seg = fx.ts_segment(spark, sf).select("segment", "idx", "total")
    two = lagged(seg, ["total"], [1], keys=["segment"]).select(
        "segment", "idx", "total", (F.col("total") - F.coalesce("total_lag1", "total")).alias("change")).where("idx >= 1")
    two = cut_lineage(two.withColumn("idx", F.col("idx") - 1).withColumn("change", F.sin(F.col("change") / 1e5)))
    return r6(_vfc(two, ["total", "change"], _vf(two, ["total", "change"], 2, keys=["segment"]), 2, 5, keys=["segment"]))


def user_model_impute(spark, sf):
    """I4 per user: gaps of the event values filled by each user's own AR(1) regression."""
    from ..operators.learn import model_impute as _mi
    ev = fx.ld_events(spark, sf).select("user_id", F.col("visit").alias("idx"), "value")
    return r6(_mi(ev, "value", ar_lag=1, keys=["user_id"]), 4)


def arima_likelihood(spark, sf):
    """ARMA(1, 1) of the daily order totals by exact maximum likelihood."""
    from ..operators.likelihood import arima_mle
    d = fx.ts_daily(spark, sf).select("idx", F.col("total").alias("value"))
    return r6(arima_mle(d, 1, 0, 1), 3)


# ------------------------------------------- single operators, checked by SQL

def complete_columns(spark, sf):
    """The event columns without a missing value, and whether any other has one."""
    ev = fx.ld_events(spark, sf)
    cols = ["user_id", "event_type", "value", "k", "visit"]
    gaps = ms.has_missing(ev, cols)
    return ms.missing_profile(ev, cols).where("n_missing = 0").select("variable", "n_rows", F.lit(gaps).alias("others_missing"))


def granger_edges(spark, sf):
    """Edges of the lag-1 causality network of the differenced hourly series, p < 0.05."""
    from ..operators.linear import causality_edges, filter_causality, granger, granger_matrix
    d = tf.difference(hourly_filled(spark, sf), VARS, order=1, check=False)
    tests = granger(d, VARS, maxlag=1).where(F.col("target") != F.col("source"))
    return causality_edges(filter_causality(granger_matrix(tests)))[1]


def granger_causes(spark, sf):
    """The variables that cause ``click`` at lag 1 with p < 0.05."""
    from ..operators.linear import granger, granger_by_variable
    d = tf.difference(hourly_filled(spark, sf), VARS, order=1, check=False)
    tests = granger(d, VARS, maxlag=1).where(F.col("target") != F.col("source"))
    return granger_by_variable(tests, "click").select("target", "source", F.col("best_lag").cast("int").alias("best_lag"))


def lag_links(spark, sf):
    """Links of the autocorrelations beyond the Bartlett band, over lags 1 to 12."""
    from ..operators.causality import parse_links
    a = dg.acf(hourly_diff_long(spark, sf), nlags=12)
    slots = a.where("lag >= 1").select(F.col(dg.V).alias("source"), F.col(dg.V).alias("target"), (F.abs("acf") > F.col("band")).alias("significant"),
                                       F.abs("acf").alias("q_value"))
    return r6(parse_links(slots))


def residual_verdicts(spark, sf):
    """Share of lags 1 to 10 whose Ljung-Box p-value of the naive residuals is below 0.05."""
    return r6(dg.ljung_box_share(ljung_box_naive(spark, sf)))


def naive_leaderboard(spark, sf):
    """the naive model's MAE per variable with the verdict on its residuals."""
    from ..operators.results import leaderboard as _lb
    model = F.lit("naive").alias("model")
    mae, share = (t.select("*", model) for t in (mae_naive(spark, sf), dg.ljung_box_share(ljung_box_naive(spark, sf))))
    return r6(_lb(mae, share))


def order_walk(spark, sf):
    """Successive minima of the mean order price over the grid of month and
    weekday, walked along its anti-diagonals."""
    from ..operators.results import running_minima, walk_order
    o = fx.read_table(spark, sf, "orders", ["o_orderdate", "o_totalprice"])
    grid = o.groupBy((F.month("o_orderdate") - 1).alias("p"), F.weekday("o_orderdate").alias("q")).agg(F.avg("o_totalprice").alias("price"))
    return r6(running_minima(grid, ["price"], [walk_order(12, 7)]), 4)


def band_table(spark, sf):
    """Mean event value per hour of the day with lowest and highest value, one row per hour."""
    from ..operators.results import forecast_wide
    e = fx.read_table(spark, sf, "events", ["ts", "event_type", "value"]).where("event_type IS NOT NULL")
    long = e.groupBy(F.col("event_type").alias("variable"), F.hour("ts").cast("long").alias("idx")).agg(
        F.avg("value").alias("mean"), F.min("value").alias("lower"), F.max("value").alias("upper"))
    return r6(forecast_wide(long, VARS))


def stored_results(spark, sf):
    """yearly mean prices per order status as stored results; the last year's
    replace those of the same status, and results over days too few or many go."""
    from ..operators.results import upsert_results
    o = fx.read_table(spark, sf, "orders", ["o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    o = o.withColumn("year", F.year("o_orderdate"))
    res = o.groupBy("year", F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("variable")).agg(
        F.avg("o_totalprice").alias("mae"), F.countDistinct(F.weekday("o_orderdate")).alias("test_size"))
    last = F.lit(o.agg(F.max("year")).first()[0])
    return r6(upsert_results(res.where(F.col("year") == last - 1), res.where((F.col("year") == last) & (F.col("variable") != "F")), reset_gap=1), 4)


def rbm_encode_all(spark, sf):
    """T9 over all documents: language and source one-hot, and the labels with a level of their own for none."""
    d = fx.ml_docs(spark, sf, how="left")
    cols = ["lang", "source", "quality", "toxic"]
    d = d.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in cols])
    return tf.encode_for_rbm(d, cols, keep=["doc_id"])[0]


def joined_bands(spark, sf):
    """Mean, lowest and highest event value per type and hour of the day, from three frames."""
    from ..operators.results import join_bands
    e = fx.read_table(spark, sf, "events", ["ts", "event_type", "value"]).where("event_type IS NOT NULL").select(
        "event_type", F.hour("ts").cast("long").alias("idx"), "value")
    frames = [e.groupBy("event_type", "idx").agg(f("value").alias("v")) for f in (F.avg, F.min, F.max)]
    return r6(join_bands(*frames, keys=["event_type"]))


def observed_fitted(spark, sf):
    """Daily order totals and the total a week before, which the first week lacks."""
    from ..operators.results import observed_and_fitted
    d = fx.ts_daily(spark, sf).select("idx", "total")
    week = d.select((F.col("idx") + 7).alias("idx"), F.col("total").alias("fitted"))
    return r6(observed_and_fitted(d, week), 4)


def type_pairs(spark, sf):
    """All ordered pairs of event types."""
    from ..operators.results import ordered_pairs
    return ordered_pairs(fx.read_table(spark, sf, "events", ["event_type"]).where("event_type IS NOT NULL"), "event_type")


def forecast_input(spark, sf):
    """The last five hours of the filled series with three lags."""
    return r6(tf.last_windows(hourly_filled(spark, sf), VARS, 3, last_step=5))


def user_options(spark, sf):
    """The users of the events as options, with one for all."""
    from ..sources.csv import subject_options
    return subject_options(fx.read_table(spark, sf, "events", ["user_id"]), "user_id", add_all=True)

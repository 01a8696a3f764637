"""Time-series diagnostics on long tables ``(series keys, variable, idx, value)``.

ACF products come from one halo pass over the lagged values; decomposition is
a centred window plus a phase-mean table; Fisher's periodogram is a
distributed DFT (partial DFT per block, summed by frequency)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, norm_ppf
from ..session import block_size
from .layout import to_long
from .ordering import _cols, add_blocks, halo_window
from .validate import complete, maybe_broadcast, require

V = "variable"


def long_series(df: DataFrame, cols: Sequence[str], idx: str = "idx", keys=()) -> DataFrame:
    return to_long(df.select(*_cols(keys), idx, *cols), [*_cols(keys), idx], cols, V, "value")


def default_nlags(n: int, cap: int = 50) -> int:
    return max(0, min(cap, n // 2 - 1))


def acf(long: DataFrame, nlags: int | None = None, alpha: float | None = 0.05, idx: str = "idx",
        keys=(), value: str = "value", size: int | None = None, cap: int = 50) -> DataFrame:
    """Autocorrelation per variable for lags 0..nlags (default
    ``min(50, n//2 - 1)``) with the Bartlett band ``z * sqrt((1 + 2 sum_{j<k} r_j^2)/n)``.

    Plan: one aggregate for (n, mean) per variable; one halo pass (halo =
    nlags rows) computing all centred lag products; a final aggregate.
    Output: keys, variable, lag, acf, band (band NULL when alpha is None)."""
    g = [*_cols(keys), V]
    long = long.select(*g, idx, complete(F.col(value), "the autocorrelation").alias(value))
    stats = long.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"))
    auto = nlags is None
    if auto:
        # products up to the cap in the same pass; each series then keeps the
        # lags up to min(cap, n//2 - 1) of its own length (no sizing job)
        nlags = cap
    # one row per series: broadcast while it is small, so that the rows are not dealt by series
    centred = long.join(maybe_broadcast(stats), g).withColumn("_xc", F.col(value) - F.col("_mean"))

    def exprs(w):
        return {f"_p{k}": F.col("_xc") * F.lag("_xc", k).over(w) for k in range(1, nlags + 1)}

    prods = halo_window(centred.select(*g, idx, "_xc", "_n"), exprs, idx, g, before=nlags, size=size) \
        if nlags > 0 else centred
    sums = prods.groupBy(*g).agg(F.first("_n").alias("_n"), F.sum(F.col("_xc") * F.col("_xc")).alias("_c0"),
                                 *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(1, nlags + 1)])
    arr = F.array(F.col("_c0"), *[F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) for k in range(1, nlags + 1)])
    out = sums.select(*g, "_n", F.posexplode(arr).alias("lag", "_s"), "_c0")
    out = out.select(*g, F.col("lag").cast("long").alias("lag"), "_n",
                     F.try_divide(F.col("_s"), F.col("_c0")).alias("acf"))
    if auto:
        out = out.where(F.col("lag") <= F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(F.col("_n") / 2) - 1)))
    if alpha is None:
        return out.select(*g, "lag", "acf", F.lit(None).cast("double").alias("band"))
    z = norm_ppf(1 - alpha / 2.0)
    w = Window.partitionBy(*g).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.sum(F.when(F.col("lag") >= 1, F.col("acf") * F.col("acf"))).over(w), F.lit(0.0))
    band = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(
        F.lit(z) * F.sqrt((F.lit(1.0) + F.lit(2.0) * prev) / F.col("_n")))
    return out.select(*g, "lag", "acf", band.alias("band"))


def pacf(acf_df: DataFrame, keys=()) -> DataFrame:
    """Partial autocorrelation (Yule-Walker, biased autocovariances) by the
    Durbin-Levinson recursion on the ACF of each variable.  The ACF table is
    already aggregated (<= 51 rows per variable); one pandas group per variable."""
    g = [*_cols(keys), V]
    schema = ", ".join([f"`{k}` {t}" for k, t in acf_df.select(*g).dtypes] + ["lag long", "pacf double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(dtype=float)
        L = len(r) - 1
        out = np.zeros(L + 1)
        out[0] = 1.0
        phi = np.zeros(L + 1)
        v = 1.0
        for k in range(1, L + 1):
            if v <= 0:
                out[k:] = np.nan
                break
            a = (r[k] - np.dot(phi[1:k], r[k - 1:0:-1])) / v
            new = phi.copy()
            new[k] = a
            new[1:k] = phi[1:k] - a * phi[k - 1:0:-1]
            phi = new
            v *= (1 - a * a)
            out[k] = a
        res = pd.DataFrame({"lag": pdf["lag"].to_numpy(), "pacf": out})
        for c in g:
            res.insert(0, c, pdf[c].iloc[0])
        return res[g + ["lag", "pacf"]]

    return acf_df.select(*g, "lag", "acf").groupBy(*g).applyInPandas(run, schema)


def plot_bands(acf_df: DataFrame, nobs: int | None = None, kind: str = "acf") -> DataFrame:
    """D3: display band column ('acf' +-0.5, 'pacf' +-0.2, residual ACF +-2/sqrt(nobs) or 0.1)."""
    if kind == "pacf":
        gap = 0.2
    elif kind == "residual":
        gap = 2.0 / math.sqrt(nobs) if nobs else 0.1
    else:
        gap = 0.5
    return acf_df.withColumn("gap", F.lit(gap))


def seasonal_decompose(long: DataFrame, period: int = 3, model: str = "additive", idx: str = "idx",
                       keys=(), value: str = "value", size: int | None = None) -> DataFrame:
    """Classical decomposition.  Trend = centred moving average (2 x MA
    for an even period, NULL at both ends); seasonal = per-phase mean of the
    detrended values minus (or divided by) the mean of the phase means;
    residual = observed - trend - seasonal (or observed / (trend * seasonal))."""
    require(period >= 2, "period >= 2")
    g = [*_cols(keys), V]
    mult = model.startswith("m")
    half = period // 2
    if period % 2:
        weights = {j: 1.0 / period for j in range(-half, half + 1)}
    else:
        weights = {j: 1.0 / period for j in range(-half + 1, half)}
        weights[-half] = weights[half] = 0.5 / period

    def exprs(w):
        t = None
        for j, wt in sorted(weights.items()):
            term = F.col(value) if j == 0 else (F.lag(value, -j).over(w) if j < 0 else F.lead(value, j).over(w))
            term = F.lit(wt) * term
            t = term if t is None else t + term
        return {"trend": t}

    tr = halo_window(long.select(*g, idx, value), exprs, idx, g, before=half, after=half, size=size)
    detr = F.try_divide(F.col(value), F.col("trend")) if mult else (F.col(value) - F.col("trend"))
    tr = tr.withColumn("_phase", F.col(idx) % F.lit(period)).withColumn("_detr", detr)
    phase = tr.groupBy(*g, "_phase").agg(F.avg("_detr").alias("_pm"))
    centre = phase.groupBy(*g).agg(F.avg("_pm").alias("_pmm"))
    phase = phase.join(centre, g).select(
        *g, "_phase", (F.try_divide(F.col("_pm"), F.col("_pmm")) if mult else (F.col("_pm") - F.col("_pmm"))).alias("seasonal"))
    out = tr.join(phase, [*g, "_phase"], "left")
    resid = F.try_divide(F.try_divide(F.col(value), F.col("seasonal")), F.col("trend")) if mult else \
        (F.col(value) - F.col("trend") - F.col("seasonal"))
    return out.select(*g, idx, F.col(value).alias("observed"), "trend", "seasonal", resid.alias("resid"))


def _split_factor(n: int) -> int:
    """Largest divisor of n not above sqrt(n) (1 for primes)."""
    best = 1
    d = 1
    while d * d <= n:
        if n % d == 0:
            best = d
        d += 1
    return best


def _fisher_freqs(n: int) -> np.ndarray:
    return np.arange(0, n // 2) if n % 2 == 0 else np.arange(1, (n - 1) // 2 + 1)


def _dft_four_step(long: DataFrame, nt: DataFrame, g: list, idx: str, value: str) -> DataFrame:
    """Exact DFT of every series by the four-step (Cooley-Tukey) split
    n = n1 * n2: column FFTs of length n1 grouped by ``idx mod n2``, twiddle,
    row FFTs of length n2 grouped by ``k1``.  Two shuffles, groups of n1 and
    n2 rows.  Emits (keys, freq, c, s) with the time of row i taken as i+1."""
    key_schema = ", ".join(f"`{k}` {t}" for k, t in long.select(*g).dtypes)
    x = long.join(nt, g).select(*g, "_n", "_n1", "_n2", (F.col(idx) % F.col("_n2")).alias("_j2"),
                                F.floor(F.col(idx) / F.col("_n2")).cast("long").alias("_j1"), F.col(value).alias("_x"))

    def cols_fft(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, j2 = int(pdf["_n"].iloc[0]), int(pdf["_n1"].iloc[0]), int(pdf["_j2"].iloc[0])
        v = np.zeros(n1)
        v[pdf["_j1"].to_numpy(dtype=np.int64)] = pdf["_x"].to_numpy(dtype=float)
        k1 = np.arange(n1)
        y = np.fft.fft(v) * np.exp(-2j * np.pi * j2 * k1 / n)
        out = pd.DataFrame({"_k1": k1, "_j2": j2, "_re": y.real, "_im": y.imag,
                            "_n": n, "_n1": n1, "_n2": int(pdf["_n2"].iloc[0])})
        for c in reversed(g):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    mid = x.groupBy(*g, "_j2").applyInPandas(
        cols_fft, key_schema + ", _k1 long, _j2 long, _re double, _im double, _n long, _n1 long, _n2 long")

    def rows_fft(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2, k1 = (int(pdf[c].iloc[0]) for c in ("_n", "_n1", "_n2", "_k1"))
        z = np.zeros(n2, dtype=complex)
        z[pdf["_j2"].to_numpy(dtype=np.int64)] = pdf["_re"].to_numpy() + 1j * pdf["_im"].to_numpy()
        f = k1 + n1 * np.arange(n2)
        X = np.fft.fft(z) * np.exp(-2j * np.pi * f / n)        # time index i + 1
        lo, hi = (0, n // 2 - 1) if n % 2 == 0 else (1, (n - 1) // 2)
        keep = (f >= lo) & (f <= hi)
        out = pd.DataFrame({"freq": f[keep].astype(np.int64), "c": X.real[keep], "s": -X.imag[keep]})
        for c in reversed(g):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return mid.groupBy(*g, "_k1").applyInPandas(rows_fft, key_schema + ", freq long, c double, s double")


def _dft_whole(long: DataFrame, nt: DataFrame, g: list, idx: str, value: str) -> DataFrame:
    """DFT of series that are no longer than a block: one group each."""
    key_schema = ", ".join(f"`{k}` {t}" for k, t in long.select(*g).dtypes)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_n"].iloc[0])
        y = np.zeros(n)
        y[pdf[idx].to_numpy(dtype=np.int64)] = pdf[value].to_numpy(dtype=float)
        freqs = _fisher_freqs(n)
        z = np.fft.fft(y)[freqs] * np.exp(-2j * np.pi * freqs / n)              # time index i + 1
        res = pd.DataFrame({"freq": freqs.astype(np.int64), "c": z.real, "s": -z.imag})
        for c in reversed(g):
            res.insert(0, c, pdf[c].iloc[0])
        return res

    return long.select(*g, idx, value).join(nt.select(*g, "_n"), g).groupBy(*g).applyInPandas(
        whole, key_schema + ", freq long, c double, s double")


def _complex_fft(rows: DataFrame, g: list, pairs: list[str], product: bool) -> DataFrame:
    """Four-step FFTs of length ``_m`` = ``_n1`` * ``_n2`` of several complex
    vectors at once: rows (keys, _n, _m, _n1, _n2, _i, <p>r, <p>i of every p in
    ``pairs``), missing places zero.  Gives _i, _re, _im: of the vectors' product
    or of the only one."""
    key_schema = ", ".join(f"`{k}` {t}" for k, t in rows.select(*g).dtypes)
    sizes = ["_n", "_m", "_n1", "_n2"]
    parts = [f"{p}{x}" for p in pairs for x in "ri"]
    x = rows.select(*g, *sizes, *parts, (F.col("_i") % F.col("_n2")).alias("_j2"), F.floor(F.col("_i") / F.col("_n2")).alias("_j1"))

    def frame(pdf, columns):
        out = pd.DataFrame(columns)
        for c in sizes:
            out[c] = int(pdf[c].iloc[0])
        for c in reversed(g):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    def spread(pdf, place, length, p):
        v = np.zeros(length, complex)
        np.add.at(v, pdf[place].to_numpy(np.int64), pdf[f"{p}r"].to_numpy(float) + 1j * pdf[f"{p}i"].to_numpy(float))
        return v

    def columns_pass(pdf):
        m, n1, j2 = (int(pdf[c].iloc[0]) for c in ("_m", "_n1", "_j2"))
        k1 = np.arange(n1)
        turn = np.exp(-2j * np.pi * (j2 * k1 % m) / m)
        out = {"_k1": k1, "_j2": j2}
        for p in pairs:
            v = np.fft.fft(spread(pdf, "_j1", n1, p)) * turn
            out |= {f"{p}r": v.real, f"{p}i": v.imag}
        return frame(pdf, out)

    def rows_pass(pdf):
        n1, n2, k1 = (int(pdf[c].iloc[0]) for c in ("_n1", "_n2", "_k1"))
        v = np.ones(n2, complex)
        for p in pairs:
            v = v * np.fft.fft(spread(pdf, "_j2", n2, p))
        return frame(pdf, {"_i": k1 + n1 * np.arange(n2), "_re": v.real, "_im": v.imag})

    assert product or len(pairs) == 1
    own = ", ".join(f"{c} long" for c in sizes)
    mid = x.groupBy(*g, "_j2").applyInPandas(columns_pass, f"{key_schema}, _k1 long, _j2 long, {', '.join(f'{c} double' for c in parts)}, {own}")
    return mid.groupBy(*g, "_k1").applyInPandas(rows_pass, f"{key_schema}, _i long, _re double, _im double, {own}")


def _dft_chirp(long: DataFrame, nt: DataFrame, g: list, idx: str, value: str) -> DataFrame:
    """Exact DFT of any length n by the chirp-z identity
    X_k = w_k sum_j (x_j w_j) / w_(k-j), w_j = exp(-i pi j^2 / n): a circular
    convolution at a power of two, by four-step FFTs in groups of about the
    root of that power.  Emits (keys, freq, c, s)."""
    n, m = F.col("_n"), F.col("_m")
    # the smallest power of two from 2n - 1 on, split into two of about its root
    power = F.ceil(F.log2(2.0 * n - 1.0)).cast("int")
    sized = nt.select(*g, "_n", power.alias("_p")).select(
        *g, "_n", F.expr("shiftleft(1L, _p)").alias("_m"), F.expr("shiftleft(1L, _p div 2)").alias("_n1"),
        F.expr("shiftleft(1L, _p - _p div 2)").alias("_n2"))

    def angle(j):                               # of w_j, negated; j^2 as a remainder keeps it exact
        return F.lit(math.pi) * F.pmod(j * j, 2 * n) / n
    j = F.col(idx).cast("long")
    x = F.col(value).cast("double")
    cos, sin = F.cos(angle(j)), F.sin(angle(j))

    def place(i, ar, ai):
        return F.struct(i.alias("_i"), ar.alias("ar"), ai.alias("ai"), cos.alias("br"), sin.alias("bi"))
    zero = F.lit(0.0)
    rows = long.select(*g, idx, value).join(sized, g).withColumn("_at", F.explode(F.when(
        j > 0, F.array(place(j, x * cos, -x * sin), place(m - j, zero, zero))).otherwise(F.array(place(j, x * cos, -x * sin)))))
    sizes = ["_n", "_m", "_n1", "_n2"]
    spectrum = _complex_fft(rows.select(*g, *sizes, "_at.*"), g, ["a", "b"], product=True)
    # the inverse transform is the conjugate of that of the conjugate
    back = _complex_fft(spectrum.select(*g, *sizes, "_i", F.col("_re").alias("ar"), (-F.col("_im")).alias("ai")), g, ["a"], product=False)
    k = F.col("_i")
    lo = F.when(n % 2 == 0, 0).otherwise(1)
    hi = F.when(n % 2 == 0, F.floor(n / 2) - 1).otherwise(F.floor((n - 1) / 2))
    turn = angle(k) + F.lit(2 * math.pi) * k / n                # w_k and the time index i + 1
    re, im = F.col("_re") / m, -F.col("_im") / m
    return back.where((k >= lo) & (k <= hi)).select(
        *g, k.alias("freq"), (re * F.cos(turn) + im * F.sin(turn)).alias("c"), (re * F.sin(turn) - im * F.cos(turn)).alias("s"))


def fisher_g(long: DataFrame, idx: str = "idx", keys=(), value: str = "value",
             size: int | None = None) -> DataFrame:
    """Fisher's g = max periodogram ordinate / sum of ordinates.

    Odd n: frequencies 1..(n-1)/2, cosine and sine sums scaled 2/n and
    I = n/2 (a^2 + b^2).  Even n: frequencies 0..n/2-1, cosine only, scaled
    1/n and I = n a^2 (reproduced as the reference computes it).  Time of row
    i is i+1.  The periodogram is an exact distributed DFT: the four-step FFT
    when n = n1 * n2 with both factors within the block size; otherwise, for a
    series longer than a block, the chirp-z transform, which takes any length."""
    g = [*_cols(keys), V]
    size = block_size(long.sparkSession, size)
    nt = long.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))

    @F.pandas_udf("long")
    def n1_of(n: pd.Series) -> pd.Series:
        return n.map(lambda v: _split_factor(int(v))).astype("int64")

    nt = nt.withColumn("_n1", n1_of("_n")).withColumn("_n2", (F.col("_n") / F.col("_n1")).cast("long"))
    four = (F.col("_n1") > 1) & (F.col("_n2") <= F.lit(size))
    nt = F.broadcast(nt) if not _cols(keys) else nt              # one row per variable: schema-sized
    short = ~four & (F.col("_n") <= size)
    parts = _dft_four_step(long, nt.where(four), g, idx, value).unionByName(
        _dft_whole(long, nt.where(short), g, idx, value)).unionByName(
        _dft_chirp(long, nt.where(~four & ~short), g, idx, value))
    tot = parts.join(nt.select(*g, "_n"), g)
    n = F.col("_n").cast("double")
    even = (F.col("_n") % 2) == 0
    a = F.when(even, F.col("c") / n).otherwise(F.lit(2.0) * F.col("c") / n)
    bb = F.lit(2.0) * F.col("s") / n
    I = F.when(even, n * a * a).otherwise(n / F.lit(2.0) * (a * a + bb * bb))
    per = tot.select(*g, "freq", I.alias("I"))
    return per.groupBy(*g).agg(F.try_divide(F.max("I"), F.sum("I")).alias("g"),
                               F.count(F.lit(1)).alias("n_freq"))


def ljung_box(acf_df: DataFrame, nobs: DataFrame, lags: int = 10, keys=(), alpha: float = 0.05) -> DataFrame:
    """Ljung-Box Q_h = n(n+2) sum_{k<=h} r_k^2/(n-k) and its chi^2(h)
    p-value for h = 1..lags.  ``nobs`` has (keys, variable, n)."""
    g = [*_cols(keys), V]
    a = acf_df.where((F.col("lag") >= 1) & (F.col("lag") <= lags)).join(nobs, g)
    w = Window.partitionBy(*g).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = (F.col("n") * (F.col("n") + 2) * F.sum(F.try_divide(F.col("acf") * F.col("acf"),
                                                               (F.col("n") - F.col("lag")).cast("double"))).over(w))
    out = a.select(*g, "lag", q.alias("q_stat"))
    return out.withColumn("p_value", F.pandas_udf(_chi2_tail, "double")("q_stat", "lag"))


def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """chi^2 upper tail over an Arrow batch of (statistic, df)."""
    return pd.Series([None if pd.isna(a) else chi2_sf(float(a), int(d)) for a, d in zip(x, df)], dtype="float64")


def ljung_box_share(lb: DataFrame, keys=(), alpha: float = 0.05) -> DataFrame:
    """Share of lags with p < alpha; ``all_lags_below`` reproduces the
    reference's integer division (1 only when every lag is below)."""
    g = [*_cols(keys), V]
    below = F.count_if(F.col("p_value") < alpha)
    return lb.groupBy(*g).agg(
        (below / F.count(F.lit(1))).alias("share"),
        F.floor(below / F.count(F.lit(1))).cast("int").alias("all_lags_below"))


def durbin_watson(long: DataFrame, idx: str = "idx", keys=(), value: str = "value",
                  size: int | None = None) -> DataFrame:
    """sum((e_t - e_{t-1})^2) / sum(e_t^2) per variable."""
    g = [*_cols(keys), V]
    d = halo_window(long.select(*g, idx, value), lambda w: {"_d": F.col(value) - F.lag(value, 1).over(w)},
                    idx, g, before=1, size=size)
    return d.groupBy(*g).agg(F.try_divide(F.sum(F.col("_d") * F.col("_d")),
                                          F.sum(F.col(value) * F.col(value))).alias("dw"))


def mae(pairs: DataFrame, observed: str = "observed", predicted: str = "predicted", keys=(V,)) -> DataFrame:
    """Mean absolute error per variable."""
    return pairs.groupBy(*_cols(keys)).agg(F.avg(F.abs(F.col(predicted) - F.col(observed))).alias("mae"))


def residuals(observed: DataFrame, predicted: DataFrame, idx: str = "idx", keys=(V,), value: str = "value",
              pred: str = "predicted") -> DataFrame:
    """Observed - predicted aligned on the position (inner join)."""
    k = [*_cols(keys), idx]
    j = observed.select(*k, F.col(value).alias("observed")).join(predicted.select(*k, pred), k)
    return j.select(*k, "observed", pred, (F.col("observed") - F.col(pred)).alias("residual"))


def histogram(long: DataFrame, bins: int = 10, value: str = "value", keys=(V,)) -> DataFrame:
    """Equal-width histogram per variable (last bin closed)."""
    g = _cols(keys)
    r = long.groupBy(*g).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    h = long.join(r, g).select(*g, b.alias("bin"), "_lo", w.alias("_w"))
    return h.groupBy(*g, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.first(F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        F.first(F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"))

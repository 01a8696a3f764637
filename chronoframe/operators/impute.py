"""Imputation: neighbour mean, interpolation, carry forward / backward,
imputation training sets and the method dispatcher."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .missing import get_subject
from .ordering import _cols, blocked_cumsum, blocked_fill, halo_window
from .validate import require, require_missing


def nearest_mean(df: DataFrame, cols: Sequence[str], n: int = 2, idx: str = "idx", keys=(),
                 size: int | None = None) -> DataFrame:
    """A missing value becomes the mean of the observed values at positions
    ``i-n .. i+n`` of the original data; an empty neighbourhood stays missing."""
    require(n >= 1, "neighbourhood size >= 1")

    def exprs(w):
        frame = w.rangeBetween(-n, n)
        return {c: F.coalesce(F.col(c), F.avg(c).over(frame)) for c in cols}

    return halo_window(df, exprs, idx, keys, before=n, after=n, size=size)


def locf(df: DataFrame, cols: Sequence[str], visit: str, subject: str | None = None,
         nocb: bool = False, subjects_df: DataFrame | None = None, subject_ids=None,
         size: int | None = None) -> DataFrame:
    """Carry the last observation forward per subject (then, with
    ``nocb``, the next observation backward).  A fill never crosses subjects.
    With ``subject_ids``/``subjects_df`` only those subjects are filled; the
    other rows pass through unchanged."""
    keys = [subject] if subject else []
    if subject and (subject_ids is not None or subjects_df is not None):
        chosen = get_subject(df, subject, subject_ids, subjects_df)
        rest = df.join(chosen.select(subject).distinct(), subject, "left_anti")
        return locf(chosen, cols, visit, subject, nocb, size=size).unionByName(rest)
    return blocked_fill(df, cols, visit, keys, "both" if nocb else "forward", size)


def interpolate(df: DataFrame, cols: Sequence[str], order: int = 1, idx: str = "idx", keys=(),
                size: int | None = None) -> DataFrame:
    """Fill gaps with the polynomial of degree ``order`` through ``order+1``
    consecutive observed points around the gap (order 1 = linear between the
    neighbours).  A leading gap stays missing; a trailing gap is extrapolated
    from the last ``order+1`` observations.

    Plan: all columns at once in long form ``(keys, variable, idx, value)``;
    observed rows are numbered per series by a blocked running count; every
    gap row picks the first rank of its point set, the ranks are exploded
    (``order+1`` rows per gap row) and equi-joined to the observed rows; the
    Lagrange form is evaluated with array higher-order functions; the fills
    are joined back on (keys, idx)."""
    require(1 <= order <= 5, "order must be in 1..5")
    keys = _cols(keys)
    k = order
    var = "_var"
    long = df.select(*keys, idx, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [*keys, idx], list(cols), var, "_y")
    g = [*keys, var]
    base = long.withColumn("_obs", F.col("_y").isNotNull().cast("long"))
    run = blocked_cumsum(base, ["_obs"], idx, g, size)              # observed count up to the row
    total = run.groupBy(*g).agg(F.max("_obs_cum").alias("_m"))
    obs = run.where(F.col("_obs") == 1).select(
        *g, (F.col("_obs_cum") - 1).alias("_rank"), F.col(idx).cast("double").alias("_px"), F.col("_y").alias("_py"))
    gaps = run.where((F.col("_obs") == 0) & (F.col("_obs_cum") > 0)).join(total, g)
    rprev = F.col("_obs_cum") - 1
    start = F.greatest(F.lit(0), F.least(rprev - F.lit((k - 1) // 2), F.col("_m") - F.lit(k + 1)))
    gx = gaps.where(F.col("_m") >= k + 1).select(*g, F.col(idx), F.explode(F.sequence(start, start + F.lit(k))).alias("_rank"))
    pts = gx.join(obs, [*g, "_rank"]).groupBy(*g, idx).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_px", "_py"))).alias("_pts"))
    x = F.col(idx).cast("double")

    def basis(p, j):
        others = F.filter(F.col("_pts"), lambda q, l: l != j)
        return p["_py"] * F.aggregate(others, F.lit(1.0), lambda acc, q: acc * (x - q["_px"]) / (p["_px"] - q["_px"]))

    val = F.aggregate(F.transform(F.col("_pts"), basis), F.lit(0.0), lambda a, b: a + b)
    fills = pts.select(*keys, idx, var, val.alias("_fill")).groupBy(*keys, idx).agg(
        *[F.max(F.when(F.col(var) == F.lit(c), F.col("_fill"))).alias(f"_fill_{c}") for c in cols])
    res = df.join(fills, [*keys, idx], "left")
    return res.select(*[F.coalesce(F.col(c), F.col(f"_fill_{c}")).alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def imputation_sets(df: DataFrame, cols: Sequence[str], ar_lag: int = 1, idx: str = "idx",
                    size: int | None = None, keys=()) -> DataFrame:
    """Features x_t .. x_{t-ar_lag+1} (missing lags -> 0), targets x_{t+1};
    ``set`` = train (no missing input or target), test (input complete, target
    missing), both (both missing).  Rows with a missing input but an observed
    target belong to no set and are dropped, as is the last row."""
    lags = list(range(1, ar_lag))

    def exprs(w):
        out = {}
        for c in cols:
            for k in lags:
                out[f"{c}_lag{k}"] = F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
            out[f"{c}_next"] = F.lead(c, 1).over(w)
        out["_last"] = F.lead(F.lit(1), 1).over(w).isNull()
        return out

    keys = _cols(keys)
    out = halo_window(df.select(*keys, idx, *cols), exprs, idx, keys, before=max(lags, default=0), after=1, size=size)
    x_miss = None
    y_miss = None
    for c in cols:
        xm, ym = F.col(c).isNull(), F.col(f"{c}_next").isNull()
        x_miss = xm if x_miss is None else (x_miss | xm)
        y_miss = ym if y_miss is None else (y_miss | ym)
    st = (F.when(~x_miss & ~y_miss, "train").when(~x_miss, "test").when(x_miss & y_miss, "both"))
    return out.where(~F.col("_last")).drop("_last").withColumn("set", st).where(F.col("set").isNotNull())


def impute(method: str, df: DataFrame, cols: Sequence[str], subject: str, visit: str,
           subjects_df: DataFrame | None = None, subject_ids=None, **kw) -> DataFrame:
    """Dispatcher over the longitudinal imputations.  With ``subject_ids``
    or ``subjects_df`` only those subjects are filled, by any method; needs at
    least one missing value in ``cols``."""
    chosen = {"subjects_df": subjects_df, "subject_ids": subject_ids}
    require_missing(df, cols, "imputation")
    if method in ("locf", "nocb"):
        return locf(df, cols, visit, subject, nocb=method == "nocb" or kw.get("nocb", False), **chosen)
    if method in ("missforest", "forest"):
        from .learn import forest_impute
        return forest_impute(df, cols, subject=subject, **chosen, **kw)
    if method in ("iterative", "chained"):
        from .learn import chained_impute
        return chained_impute(df, cols, subject=subject, **chosen, **kw)
    raise ValueError(f"unknown imputation method {method!r}")


def apply_imputation(df: DataFrame, imputed: DataFrame, cols: Sequence[str], idx: str = "idx", keys=()) -> DataFrame:
    """Accept imputed columns into the dataset (aligned on the index)."""
    keys = _cols(keys)
    rhs = imputed.select(*keys, idx, *[F.col(c).alias(f"_imp_{c}") for c in cols])
    j = df.join(rhs, [*keys, idx], "left")
    return j.select(*[F.coalesce(F.col(f"_imp_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in df.columns])

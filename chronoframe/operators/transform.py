"""Differencing, scaling, binning, encoders and lag/lead feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import _cols, blocked_cumsum, dense_index, halo_window, lagged
from .validate import bounded_distinct, maybe_broadcast, require, require_complete


# ---------------------------------------------------------------- differencing

def difference(df: DataFrame, cols: Sequence[str], order: int = 1, idx: str = "idx", keys=(),
               size: int | None = None, check: bool = True) -> DataFrame:
    """``order``-th difference, first ``order`` rows dropped, ``idx`` re-based
    to 0.  Computed in one halo pass with binomial weights
    ``sum_j (-1)^j C(d, j) x_{t-j}``."""
    require(order >= 1, "order must be >= 1")
    if check:
        require_complete(df, cols, "differencing")

    def exprs(w):
        out = {}
        for c in cols:
            e = F.col(c)
            for j in range(1, order + 1):
                e = e + F.lit(float((-1) ** j * comb(order, j))) * F.lag(c, j).over(w)
            out[c] = e
        return out

    out = halo_window(df, exprs, idx, keys, before=order, size=size)
    return out.where(F.col(idx) >= order).withColumn(idx, F.col(idx) - F.lit(order))


def reverse_difference(df: DataFrame, col: str, seeds: Sequence[float], idx: str = "idx",
                       size: int | None = None) -> DataFrame:
    """Undo ``len(seeds)`` differences of one column.  ``seeds[0]`` is the
    first value of the original series, ``seeds[1]`` the first value of its
    first difference, and so on; the innermost difference is undone first.
    Every inversion adds one row (the seed) at ``idx`` 0."""
    require(len(seeds) >= 1, "one seed per inversion")
    spark = df.sparkSession
    cur = df.select(F.col(idx).cast("long").alias(idx), F.col(col).cast("double").alias(col))
    for seed in reversed(list(seeds)):
        run = blocked_cumsum(cur, [col], idx, size=size)
        body = run.select((F.col(idx) + 1).alias(idx), (F.col(f"{col}_cum") + F.lit(float(seed))).alias(col))
        head = spark.range(1).select(F.lit(0).cast("long").alias(idx), F.lit(float(seed)).alias(col))
        cur = head.unionByName(body)
    return cur


# -------------------------------------------------------------------- scaling

def column_ranges(df: DataFrame, cols: Sequence[str]) -> dict:
    row = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def minmax_scale(df: DataFrame, cols: Sequence[str], feature_range=(-1.0, 1.0),
                 ranges: dict | None = None) -> tuple[DataFrame, dict]:
    """T4: global min-max scaling to ``feature_range``; a constant column maps
    to the lower bound (its range is taken as 1).  Returns the scaled frame and
    the per-column (min, max) needed by ``minmax_inverse``."""
    ranges = ranges or column_ranges(df, cols)
    a, b = feature_range
    sel = []
    for c in df.columns:
        if c in ranges:
            lo, hi = ranges[c]
            rng = (hi - lo) if (lo is not None and hi is not None and hi != lo) else 1.0
            scale = (b - a) / rng
            sel.append((F.col(c) * F.lit(scale) + F.lit(a - (lo or 0.0) * scale)).alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel), ranges


def minmax_inverse(df: DataFrame, ranges: dict, feature_range=(-1.0, 1.0), cols: Sequence[str] | None = None) -> DataFrame:
    """T5: undo ``minmax_scale`` for the chosen output columns only."""
    a, b = feature_range
    cols = set(cols or ranges)
    sel = []
    for c in df.columns:
        base = c.rsplit("__", 1)[0]
        if base in ranges and c in cols | {x for x in df.columns if x.rsplit("__", 1)[0] in cols}:
            lo, hi = ranges[base]
            rng = (hi - lo) if hi != lo else 1.0
            scale = (b - a) / rng
            sel.append(((F.col(c) - F.lit(a - lo * scale)) / F.lit(scale)).alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


# -------------------------------------------------------------------- binning

def equal_width_edges(lo: float, hi: float, k: int) -> list[float]:
    """Bin edges of an equal-width cut with ``k`` bins: ``k+1`` evenly spaced
    points over [lo, hi]; the first edge is widened by 0.1 % of the range so
    that the minimum falls in bin 0 (right-closed intervals)."""
    if lo == hi:
        lo = lo - (0.001 * abs(lo) if lo != 0 else 0.001)
        hi = hi + (0.001 * abs(hi) if hi != 0 else 0.001)
        step = (hi - lo) / k
        edges = [lo + i * step for i in range(k)] + [hi]
        return edges
    step = (hi - lo) / k
    edges = [i * step + lo for i in range(k)] + [hi]
    edges[0] = edges[0] - (hi - lo) * 0.001
    return edges


def bin_equal_width(df: DataFrame, col: str, k: int, encode: bool = True, out: str | None = None,
                    precision: int = 3) -> tuple[DataFrame, list[float]]:
    """Equal-width discretisation (the reference's 'quantile' binning is an
    equal-width cut).  ``code`` = number of inner edges strictly below x, so ties
    on an edge fall in the lower bin without any float division.  With
    ``encode=False`` the value becomes the interval label ``(lo, hi]``."""
    require(k >= 2, "at least two bins")
    lo, hi = column_ranges(df, [col])[col]
    if lo is None:
        return df.withColumn(out or col, F.lit(None)), []
    edges = equal_width_edges(float(lo), float(hi), k)
    x = F.col(col).cast("double")
    # O(1) per row: a candidate bin from the division, then one exact comparison
    # with the neighbouring edges (the same doubles as ``edges``) fixes ties and
    # rounding: code = number of inner edges strictly below x
    inner = F.array(*[F.lit(e) for e in edges])               # edges[0..k]
    step = (edges[-1] - edges[1]) / (k - 1) if k > 1 else 1.0
    cand = F.least(F.greatest(F.ceil((x - F.lit(edges[1])) / F.lit(step)).cast("int"), F.lit(0)), F.lit(k - 1))
    e_hi = F.element_at(inner, cand + 2)                      # edges[cand + 1]
    e_lo = F.element_at(inner, cand + 1)                      # edges[cand]
    code = (F.when((cand < k - 1) & (x > e_hi), cand + 1)
            .when((cand > 0) & (x <= e_lo), cand - 1)
            .otherwise(cand))
    code = F.when(x.isNull(), None).otherwise(code).cast("int")
    if encode:
        val = code
    else:
        labels = F.array(*[F.lit(f"({round(edges[i], precision)}, {round(edges[i + 1], precision)}]")
                           for i in range(k)])
        val = F.when(code.isNull(), None).otherwise(F.element_at(labels, code + 1))
    return df.withColumn(out or col, val), edges


# ------------------------------------------------------------------- encoders

def label_encode(df: DataFrame, col: str, out: str | None = None,
                 missing_label: str = "NaN") -> tuple[DataFrame, DataFrame]:
    """Sorted distinct classes -> 0..m-1.  For a string column with NULLs
    the NULL is encoded as the class ``'NaN'`` while sorting and then set back
    to NULL, so classes after it shift by one (reproduced).  Returns
    ``(encoded frame, mapping(code, class))``.  The mapping is indexed with
    ``dense_index`` (no single-partition sort) and broadcast while its bytes
    are few."""
    out = out or col
    is_str = dict(df.dtypes)[col] == "string"
    key = F.coalesce(F.col(col), F.lit(missing_label)) if is_str else F.col(col)
    classes = df.select(key.alias("class")).where(F.col("class").isNotNull()).distinct()
    mapping = dense_index(classes, ["class"], idx="code").select(F.col("code").cast("int"), "class")
    m = maybe_broadcast(mapping)
    joined = df.withColumn("_lk", key).join(m.withColumnRenamed("class", "_lk"), "_lk", "left")
    enc = F.when(F.col(col).isNull(), None).otherwise(F.col("code"))
    cols = [enc.alias(out) if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        cols.append(enc.alias(out))
    return joined.select(*cols), mapping


def one_hot(df: DataFrame, col: str, max_levels: int = 1000, keep: bool = False) -> tuple[DataFrame, list[str]]:
    """A column with more than two distinct values becomes ``col_0 ..
    col_{m-1}`` (sorted value order; NULL, if present, last); two or fewer are
    passed through.  Returns the frame and the expanded names."""
    vals = bounded_distinct(df, col, max_levels)
    has_null = df.where(F.col(col).isNull()).limit(1).count() > 0
    levels = vals + ([None] if has_null else [])
    if len(levels) <= 2:
        return df, [col]
    names = [f"{col}_{i}" for i in range(len(levels))]
    ind = [(F.col(col).isNull() if v is None else F.col(col).eqNullSafe(F.lit(v))).cast("double") for v in levels]
    sel = []
    for c in df.columns:
        if c == col:
            if keep:
                sel.append(F.col(c))
            sel += [e.alias(nm) for e, nm in zip(ind, names)]
        else:
            sel.append(F.col(c))
    return df.select(*sel), names


def one_hot_sparse(df: DataFrame, cols: Sequence[str], row_id: str) -> DataFrame:
    """T8/T9 for any number of levels: one row per input row and column,
    (``row_id``, variable, level, n_levels), where ``level`` is the position
    that a one-hot vector of the column would set (levels in sorted order, a
    NULL last).  The codes come from joined tables, so nothing becomes a column
    name and no level is left out."""
    out = None
    for c in cols:
        levels = df.select(F.col(c).alias("_v")).distinct()
        codes = dense_index(levels, [F.col("_v").asc_nulls_last()], idx="level")
        n = codes.count()
        codes = codes.withColumnRenamed("_v", "_code")
        part = df.select(F.col(row_id), F.col(c).alias("_v")).join(
            maybe_broadcast(codes), F.col("_v").eqNullSafe(F.col("_code"))).select(
            row_id, F.lit(c).alias("variable"), F.col("level").cast("long").alias("level"), F.lit(n).cast("long").alias("n_levels"))
        out = part if out is None else out.unionByName(part)
    return out


def encode_for_rbm(df: DataFrame, cols: Sequence[str], max_levels: int = 1000,
                   keep: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[str, int]]]:
    """ValueError on missing values; >2 levels one-hot, <=2 levels a 0/1
    label.  Returns the encoded frame (``keep`` columns + encoded columns) and
    per-column widths."""
    require_complete(df, cols, "encoding")
    out = df
    widths = []
    enc_cols = []
    for c in cols:
        vals = bounded_distinct(df, c, max_levels)
        if len(vals) > 2:
            out, names = one_hot(out, c, max_levels)
            enc_cols += names
            widths.append((c, len(names)))
        else:
            out = out.withColumn(c, (F.col(c) == F.lit(vals[-1])).cast("double") if len(vals) == 2
                                 else F.lit(0.0))
            enc_cols.append(c)
            widths.append((c, 1))
    return out.select(*keep, *enc_cols), widths


# ----------------------------------------------------------- window features

def subject_windows(df: DataFrame, subject: str, visit: str, inputs: Sequence[str], target: str | None,
                    window: int, scale: bool = True, size: int | None = None) -> DataFrame:
    """Global (-1, 1) scaling of the inputs, then per subject lags
    1..window-1 named ``col_lag{k}``; lags never cross subjects; missing lags -> 0."""
    require(window >= 1, "window >= 1")
    cur = df.select(subject, visit, *inputs, *([target] if target and target not in inputs else []))
    if scale:
        cur, _ = minmax_scale(cur, inputs)
    lags = list(range(1, window))
    out = lagged(cur, inputs, lags=lags, idx=visit, keys=[subject], size=size) if lags else cur
    lag_cols = [f"{c}_lag{k}" for k in lags for c in inputs]
    return out.fillna(0.0, subset=lag_cols) if lag_cols else out


def supervised_windows(df: DataFrame, cols: Sequence[str], order: int, horizon: int, split: int,
                       val: int = 0, idx: str = "idx", size: int | None = None, s: int = 0) -> DataFrame:
    """Current values, ``order`` lags and ``horizon`` leads per row; rows
    without the last lead are dropped, missing lags -> 0; ``set`` is train
    (``idx < split``), val (last ``val`` rows) or test.  ``s`` (output chunk,
    default = horizon) must divide the horizon."""
    require(horizon >= 1, "horizon >= 1")
    s = s or horizon
    require(horizon % s == 0 and s <= horizon, f"a chunk of {s} steps does not divide a horizon of {horizon}")
    out = lagged(df.select(idx, *cols), cols, lags=range(1, order + 1), leads=range(1, horizon + 1),
                 idx=idx, size=size)
    out = out.where(F.col(f"{cols[-1]}_lead{horizon}").isNotNull())
    out = out.fillna(0.0, subset=[f"{c}_lag{k}" for k in range(1, order + 1) for c in cols])
    n_rows = out.agg(F.count(F.lit(1))).first()[0]
    st = (F.when(F.col(idx) < split, "train")
          .when(F.lit(val > 0) & (F.col(idx) >= F.lit(n_rows - val)), "val").otherwise("test"))
    return out.withColumn("set", st)


def last_windows(df: DataFrame, cols: Sequence[str], order: int, last_step: int = 1, idx: str = "idx",
                 size: int | None = None) -> DataFrame:
    """T12, the input of a forecast: the last ``last_step`` rows with their
    ``order`` lags (missing lags -> 0)."""
    require(last_step >= 1, "last_step >= 1")
    end = df.agg(F.max(idx)).first()[0]
    if end is None:
        end = 0
    # only the rows that the lags reach back to are read
    tail = df.where(F.col(idx) > end - last_step - order).select(idx, *cols)
    out = lagged(tail, cols, lags=range(1, order + 1), idx=idx, size=size).where(F.col(idx) > end - last_step)
    return out.fillna(0.0, subset=[f"{c}_lag{k}" for k in range(1, order + 1) for c in cols]) if order else out


def temporal_split(df: DataFrame, split: int, idx: str = "idx") -> DataFrame:
    """P5: positional head/tail split as a ``set`` column."""
    return df.withColumn("set", F.when(F.col(idx) < split, "train").otherwise("test"))


def subject_split(df: DataFrame, subject: str, test_subjects: DataFrame) -> DataFrame:
    """Subject hold-out split; a semi join marks the test subjects."""
    t = test_subjects.select(F.col(subject)).distinct().withColumn("_test", F.lit(True))
    return df.join(maybe_broadcast(t), subject, "left").withColumn(
        "set", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def replace_values(df: DataFrame, col: str, value, replacement) -> DataFrame:
    """Find-and-replace in one column (NULL-safe equality)."""
    c = F.col(col)
    return df.withColumn(col, F.when(c.eqNullSafe(F.lit(value)), F.lit(replacement)).otherwise(c))


def shifted(df: DataFrame, cols: Sequence[str], offset: int, idx: str = "idx", keys=()) -> DataFrame:
    """Lag (offset > 0) or lead (offset < 0) copies named ``col_lag{k}`` / ``col_lead{k}``."""
    if offset >= 0:
        return lagged(df, cols, lags=[offset], idx=idx, keys=_cols(keys))
    return lagged(df, cols, leads=[-offset], idx=idx, keys=_cols(keys))

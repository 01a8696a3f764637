"""Learned models re-aimed onto distributed lag features + ``pyspark.ml``.

The reference trains single-machine networks (Keras, MissForest, sklearn
iterative imputer, DyBM, Bernoulli RBM).  Here the features are Spark
windows over subjects/series and the estimators are ``pyspark.ml``
(distributed training); iterative procedures checkpoint their state every
round so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gram import ols_each, ols_from_gram, unpack, unpack_each
from ..session import block_size, cut_lineage
from .impute import imputation_sets
from .forest import CountedForest
from .groups import arrays, map_groups, map_rows, matrix
from .linear import STACK, _key_schema, _with_series, gram
from .ordering import BLK, HALO, _cols, add_blocks, blocked_cumsum, by_block, dense_index, halo_window, lagged
from .results import overlap_average
from .transform import minmax_scale, one_hot, supervised_windows
from .validate import bounded_distinct, require


def _regressor(kind: str, seed: int, label: str = "label"):
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, solver="normal")
    if kind == "ridge":
        return LinearRegression(featuresCol="features", labelCol=label, regParam=1e-3, elasticNetParam=0.0,
                                solver="normal")
    if kind == "gbt":
        return GBTRegressor(featuresCol="features", labelCol=label, seed=seed, maxIter=20)
    if kind == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, numTrees=50)
    raise ValueError(f"unknown estimator {kind!r}")


# ----------------------------------------------------------- I4 model impute

def model_impute(df: DataFrame, col: str, ar_lag: int = 1, estimator: str = "linear", idx: str = "idx",
                 seed: int = 42, max_rounds: int | None = None, keys=(), size: int | None = None) -> DataFrame:
    """I4: fit a regressor of x_{t+1} on x_t .. x_{t-ar_lag+1} on the complete
    rows, then repeatedly fill the first missing value after every observed
    run until no such value is left (rounds <= longest gap).  A leading gap
    is never filled.  Output: the frame with ``col`` imputed.

    The linear estimator runs one recursion per gap (:func:`_gap_recursion`), for
    every series of ``keys`` with its own coefficients, whatever the longest gap;
    a series with fewer complete rows than coefficients stays as it is.  The
    other estimators predict on the JVM only, in one job per round, over one
    series."""
    require(ar_lag >= 1, "ar_lag >= 1")
    if estimator == "linear":
        return _gap_recursion(df, col, ar_lag, idx, _cols(keys), max_rounds, size)
    require(not _cols(keys), "several series need the linear estimator")
    lag_cols = [f"{col}_lag{k}" for k in range(1, ar_lag)]
    feats = [col] + lag_cols
    sets = imputation_sets(df.select(idx, col), [col], ar_lag=ar_lag, idx=idx)
    train = sets.where(F.col("set") == "train")
    asm = VectorAssembler(inputCols=feats, outputCol="features")
    model = _regressor(estimator, seed, f"{col}_next").fit(asm.transform(train))
    cur = cut_lineage(df)
    rounds = 0
    while True:
        sets = imputation_sets(cur.select(idx, col), [col], ar_lag=ar_lag, idx=idx)
        test = sets.where(F.col("set") == "test")
        pred = model.transform(asm.transform(test)).select((F.col(idx) + 1).alias(idx),
                                                            F.col("prediction").alias("_p"))
        if pred.limit(1).count() == 0:
            return cur
        nxt = cur.join(pred, idx, "left").select(
            *[F.coalesce(F.col(c), F.col("_p")).alias(c) if c == col else F.col(c) for c in cur.columns])
        cur = cut_lineage(nxt)
        rounds += 1
        if max_rounds is not None and rounds >= max_rounds:
            return cur


def _gap_recursion(df: DataFrame, col: str, ar_lag: int, idx: str, keys: list[str], max_rounds: int | None,
                   size: int | None) -> DataFrame:
    """Gaps whose windows of ``ar_lag`` rows touch form a segment, numbered per
    series by a blocked running count.  A segment's missing rows carry the
    observations before them, so one group fills it front to back; the groups
    come many at a time, since most gaps are short.  A value is
    the k-th of its gap in the round k; a lag that is filled in that round or
    later still counts as 0, as in the rounds of the other estimators."""
    d0, own = _with_series(df.select(*keys, idx, F.col(col).cast("double").alias("_v")), keys)
    sets = imputation_sets(d0, ["_v"], ar_lag=ar_lag, idx=idx, size=size, keys=own).where(F.col("set") == "train")
    x = ["_v"] + [f"_v_lag{k}" for k in range(1, ar_lag)]
    g = gram(sets, [F.lit(1.0), *[F.col(c) for c in x], F.col("_v_next")], own)
    kinds = _key_schema(g, own)
    m = len(x) + 2

    def solve(table):
        beta = ols_each(unpack_each(matrix(table.column("g")), m), range(m - 1), [m - 1])[0]
        return {k: table.column(k) for k in own} | {"_b": arrays(beta[:, :, 0])}

    model = map_rows(g.where(F.col("n") >= m - 1), solve, f"{kinds}, _b array<double>", STACK)

    def context(w):
        before = w.rowsBetween(-ar_lag, -1)
        return {"_before": F.array(*[F.lag("_v", k).over(w) for k in range(1, ar_lag + 1)]),
                "_first": F.col("_v").isNull() & (F.count_if(F.col("_v").isNull()).over(before) == 0)}
    rows = halo_window(d0, context, idx, own, before=ar_lag, size=size)
    numbered = blocked_cumsum(rows.withColumn("_first", F.col("_first").cast("long")), ["_first"], idx, own, size)
    missing = numbered.where(F.col("_v").isNull()).select(*own, F.col(idx).cast("long").alias("_i"), "_before", F.col("_first_cum").alias("_gap"))
    limit = math.inf if max_rounds is None else max_rounds

    def run(table, starts):
        place, at, values = table.column("_i").to_pylist(), [], []
        seen_rows, models, first = matrix(table.column("_before")).tolist(), matrix(table.column("_b")), set(starts.tolist())
        for row, (i, seen) in enumerate(zip(place, seen_rows)):
            if row in first:
                b, turns = models[row].tolist(), {}
            if not math.isnan(seen[0]):
                turn = 1
            elif i - 1 in turns:
                turn = turns[i - 1][0] + 1
            else:
                continue                        # nothing before it: a leading gap
            if turn > limit:
                continue
            value = b[0]
            for k, v in enumerate(seen, 1):
                if math.isnan(v):               # filled in an earlier round, or not yet
                    when, own_value = turns.get(i - k, (math.inf, 0.0))
                    v = own_value if when < turn else 0.0
                value += b[k] * v
            turns[i] = turn, value
            at.append(row), values.append(value)
        filled = table.take(np.array(at, np.int64))
        return {k: filled.column(k) for k in [*own, "_i"]} | {"_fill": np.array(values, float)}

    fills = map_groups(missing.join(model, own), [*own, "_gap"], ["_i"], run, f"{kinds}, _i long, _fill double")
    fills = fills.select(*keys, F.col("_i").cast(df.schema[idx].dataType).alias(idx), "_fill")
    out = df.join(fills, [*keys, idx], "left")
    return out.select(*[F.coalesce(F.col(c).cast("double"), F.col("_fill")).alias(c) if c == col else F.col(c) for c in df.columns])


# -------------------------------------------------- I7 / I8 table imputation

def _initial_fill(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in numeric]).first() if numeric else {}
    fills = {c: means[c] for c in numeric if means[c] is not None}
    for c in categorical:
        m = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), F.asc(c)).first()
        if m is not None:
            fills[c] = m[0]
    return df.fillna(fills)


def _code(col, levels: list):
    """Position of a value among ``levels`` (NULL for others): one lookup in a
    map literal per row, however many levels."""
    if not levels:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(float(i)))]), col)


def _encode_categoricals(df: DataFrame, categorical: list[str], max_levels: int = 1000):
    maps = {}
    out = df
    for c in categorical:
        levels = bounded_distinct(df, c, max_levels)
        maps[c] = levels
        out = out.withColumn(c, _code(F.col(c), levels))
    return out, maps


def _decode_categoricals(df: DataFrame, maps: dict) -> DataFrame:
    out = df
    for c, levels in maps.items():
        arr = F.array(*[F.lit(v) for v in levels])
        out = out.withColumn(c, F.element_at(arr, F.col(c).cast("int") + 1))
    return out


def _round_robin(df: DataFrame, cols: list[str], categorical: list[str], make_model, max_iter: int,
                 stop: str, tol: float = 1e-3) -> DataFrame:
    """Round-robin model imputation.  Every round is narrow: the previous
    values ride along as ``_o_*`` columns, each column is re-predicted by a
    map over all rows, and the change measure is one aggregate.  The state is
    checkpointed once per round."""
    miss = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols], F.count(F.lit(1)).alias("_rows")).first()
    order = [c for c in sorted(cols, key=lambda c: (miss[c], cols.index(c))) if miss[c] > 0]
    numeric = [c for c in cols if c not in categorical]
    flagged = df.select("*", *[F.col(c).isNull().alias(f"_m_{c}") for c in cols])
    cur = cut_lineage(_initial_fill(flagged, numeric, categorical))
    base_cols = cur.columns
    prev_delta = None
    for _ in range(max_iter):
        cur = cur.select(*base_cols, *[F.col(c).alias(f"_o_{c}") for c in cols])
        for c in order:
            others = [x for x in cols if x != c]
            asm = VectorAssembler(inputCols=others, outputCol="features", handleInvalid="keep")
            model = make_model(c, c in categorical, miss["_rows"] - miss[c]).fit(asm.transform(cur.where(~F.col(f"_m_{c}"))))
            keep = cur.columns
            scored = model.transform(asm.transform(cur))
            cur = scored.select(*[F.when(F.col(f"_m_{c}"), F.col("prediction")).otherwise(F.col(x)).alias(x)
                                  if x == c else F.col(x) for x in keep])
        cur = cut_lineage(cur)
        aggs = []
        for c in numeric:
            d = F.when(F.col(f"_m_{c}"), F.col(c) - F.col(f"_o_{c}"))
            aggs += [F.sum(d * d).alias(f"d_{c}"), F.sum(F.when(F.col(f"_m_{c}"), F.col(c) ** 2)).alias(f"s_{c}"),
                     F.max(F.abs(d)).alias(f"x_{c}")]
        for c in categorical:
            aggs += [F.count_if(F.col(f"_m_{c}") & (F.col(c) != F.col(f"_o_{c}"))).alias(f"d_{c}"),
                     F.count_if(F.col(f"_m_{c}")).alias(f"s_{c}")]
        r = cur.agg(*aggs).first()
        if stop == "forest":
            num = sum(r[f"d_{c}"] or 0.0 for c in numeric) / max(sum(r[f"s_{c}"] or 0.0 for c in numeric), 1e-300)
            cat = sum(r[f"d_{c}"] or 0 for c in categorical) / max(sum(r[f"s_{c}"] or 0 for c in categorical), 1)
            delta = (num, cat)
            kinds = [k for k, present in enumerate((bool(numeric), bool(categorical))) if present]
            if prev_delta is not None and all(delta[k] > prev_delta[k] for k in kinds):
                # risen for all kinds of variables present: the previous round stays
                cur = cur.select(*[F.col(f"_o_{x}").alias(x) if x in cols else F.col(x) for x in base_cols])
                break
            prev_delta = delta
        else:
            inf = max([r[f"x_{c}"] or 0.0 for c in numeric] or [0.0])
            if inf < tol:
                cur = cur.select(*base_cols)
                break
        cur = cur.select(*base_cols)
    return cur.select(*[x for x in base_cols if not x.startswith("_m_")])


def _chosen(df: DataFrame, subject: str | None, subject_ids, subjects_df):
    """(rows of the chosen subjects, the other rows or None)."""
    if subject is None or (subject_ids is None and subjects_df is None):
        return df, None
    from .missing import get_subject
    chosen = get_subject(df, subject, subject_ids, subjects_df)
    ids = chosen.select(F.col(subject).alias("_chosen")).distinct()
    return chosen, df.join(ids, F.col(subject) == F.col("_chosen"), "left_anti")


def chained_impute(df: DataFrame, cols: Sequence[str], max_iter: int = 10, rounding: int = 3, reg: float = 1e-3,
                   subject: str | None = None, subject_ids=None, subjects_df: DataFrame | None = None) -> DataFrame:
    """I8: chained equations: mean start, then round-robin ridge regressions
    of every incomplete column on the others (ascending missing count),
    ``max_iter`` rounds or until the largest change is below the tolerance;
    values rounded to ``rounding`` decimals.  Needs >= 2 columns.  With chosen
    subjects only their rows are fitted and filled; the others pass through."""
    cols = list(cols)
    require(len(cols) >= 2, "chained equations need at least two columns")
    df, rest = _chosen(df, subject, subject_ids, subjects_df)
    # the other columns ride along through the rounds (no join back at the end)
    base = df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
    scale = base.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
    tol = 1e-3 * max([scale[c] or 0.0 for c in cols] + [1e-12])

    def make(c, _cat, _rows):
        return LinearRegression(featuresCol="features", labelCol=c, regParam=reg, elasticNetParam=0.0)

    res = _round_robin(base, cols, [], make, max_iter, "chained", tol)
    out = res.select(*[F.round(c, rounding).alias(c) if c in cols else F.col(c) for c in df.columns])
    if rest is None:
        return out
    return out.unionByName(rest.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns]))


def forest_impute(df: DataFrame, cols: Sequence[str], categorical: Sequence[str] = (), max_iter: int = 10,
                  num_trees: int = 50, seed: int = 42, subject: str | None = None, subject_ids=None,
                  subjects_df: DataFrame | None = None, counted_from: int = 1 << 18) -> DataFrame:
    """MissForest: mean/mode start; per round, columns in ascending
    missing order are re-predicted by random forests (classifier for
    categorical columns) from the others; stop when the change measure has
    risen for every kind of variable present (the previous round is kept) or
    after ``max_iter`` rounds.  String categories are encoded for the forests
    and decoded back.  With chosen subjects only their rows are fitted and
    filled; the others pass through.

    A column with ``counted_from`` or more known rows gets its forest from counts
    (:class:`CountedForest`: the same forest with other random numbers), since
    ``pyspark.ml`` takes every row to every tree in a pass per level."""
    cols = list(cols)
    categorical = list(categorical)
    require(len(cols) >= 2, "forest imputation needs at least two columns")
    df, rest = _chosen(df, subject, subject_ids, subjects_df)
    base, maps = _encode_categoricals(df, categorical)
    base = base.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])

    def make(c, cat, rows):
        kind = RandomForestClassifier if cat else RandomForestRegressor
        forest = kind(featuresCol="features", labelCol=c, numTrees=num_trees, seed=seed)
        if rows < max(counted_from, 1):
            return forest
        return CountedForest(c, [x for x in cols if x != c], len(maps[c]) if cat else 0, num_trees, seed, forest)

    res = _round_robin(base, cols, categorical, make, max_iter, "forest")
    out = _decode_categoricals(res, maps).select(*df.columns)
    if rest is None:
        return out
    kinds = dict(out.dtypes)
    return out.unionByName(rest.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns]))


# ------------------------------------------------ N1-N7 windowed regression

def window_regression(df: DataFrame, cols: Sequence[str], order: int, horizon: int, split: int,
                      outputs: Sequence[str] | None = None, estimator: str = "linear", idx: str = "idx",
                      seed: int = 42):
    """Scale to (-1, 1), supervised windows (T12/T13), one
    regressor per output column and horizon step fitted on the train rows;
    predictions for train and test rows, averaged over overlapping horizons
    (N3) and scaled back (T5).  ``estimator='linear'`` fits all outputs from
    one Gram aggregate (losses = train MSE); 'gbt' / 'forest' / 'ridge' use
    ``pyspark.ml`` (losses = objective history).  Returns (predictions,
    losses, models, ranges); predictions = (set, variable, idx, predicted,
    observed)."""
    cols = list(cols)
    outputs = list(outputs or cols)
    require(set(outputs) <= set(cols), "outputs must be inputs")
    scaled, ranges = minmax_scale(df.select(idx, *cols), cols)
    sw = supervised_windows(scaled, cols, order, horizon, split, idx=idx)
    feats = cols + [f"{c}_lag{k}" for k in range(1, order + 1) for c in cols]
    models, losses = {}, []
    if estimator == "linear":
        # every output and horizon from one Gram over [1, features, targets] of the train rows
        targets = [f"{v}_lead{h}" for v in outputs for h in range(1, horizon + 1)]
        data = cut_lineage(sw)
        z = [F.lit(1.0)] + [F.col(c).cast("double") for c in feats + targets]
        g = gram(data.where(F.col("set") == "train").withColumn("_s", F.lit(0)), z, ["_s"]).first()
        nx, m = 1 + len(feats), len(z)
        beta, ssr, _ = ols_from_gram(unpack(g["g"], m), range(nx), range(nx, m), int(g["n"]))
        cur = data
        for j, t in enumerate(targets):
            v, h = t.rsplit("_lead", 1)
            pred = F.lit(float(beta[0, j]))
            for i, f in enumerate(feats):
                pred = pred + F.lit(float(beta[1 + i, j])) * F.col(f)
            cur = cur.withColumn(f"_p_{v}_{h}", pred)
            models[(v, int(h))] = (float(beta[0, j]), beta[1:, j].copy())
            losses.append((v, int(h), 0, float(ssr[j]) / max(int(g["n"]), 1)))     # train MSE
    else:
        asm = VectorAssembler(inputCols=feats, outputCol="features")
        data = cut_lineage(asm.transform(sw))
        train = data.where(F.col("set") == "train")
        cur = data
        for v in outputs:
            for h in range(1, horizon + 1):
                mdl = _regressor(estimator, seed, f"{v}_lead{h}").fit(train)
                models[(v, h)] = mdl
                hist = getattr(getattr(mdl, "summary", None), "objectiveHistory", None) or []
                losses += [(v, h, i, float(x)) for i, x in enumerate(hist)]
                cur = mdl.transform(cur).withColumnRenamed("prediction", f"_p_{v}_{h}")
    out = None
    for v in outputs:
        arr = cur.select(idx, F.array(*[F.col(f"_p_{v}_{h}") for h in range(1, horizon + 1)]).alias("_pred"))
        avg = overlap_average(arr, idx, "_pred")
        lo, hi = ranges[v]
        rng = (hi - lo) if hi != lo else 1.0
        avg = avg.select(F.lit(v).alias("variable"), idx,
                         ((F.col("predicted") + 1.0) / 2.0 * F.lit(rng) + F.lit(lo)).alias("predicted"))
        out = avg if out is None else out.unionByName(avg)
    obs = df.select(idx, *[F.col(c).cast("double") for c in outputs]).unpivot([idx], outputs, "variable", "observed")
    out = out.join(obs, ["variable", idx], "left").withColumn(
        "set", F.when(F.col(idx) < split, "train").otherwise("test"))
    loss_df = df.sparkSession.createDataFrame(losses, "variable string, horizon int, iteration int, loss double") \
        if losses else None
    return out, loss_df, models, ranges


def forecast_recursive(df: DataFrame, cols: Sequence[str], order: int, steps: int, draws: int = 5,
                       idx: str = "idx", seed: int = 42, fraction: float = 0.8, horizon: int = 1) -> DataFrame:
    """Recursive forecast with a bagged ensemble of ``draws`` linear
    multi-output models (outputs x_{t+1} .. x_{t+horizon}; bootstrap by hash
    of the row and draw).  ``steps - horizon + 1`` recursion steps, each
    feeding back the ensemble mean of the first horizon; per step and target
    the mean and population std over draws, averaged over overlapping
    horizons, give mean +- 2 std; values scaled back.  The recursion runs on
    the coefficient vectors (model-sized) after distributed training."""
    cols = list(cols)
    require(horizon >= 1 and steps >= horizon, "steps >= horizon >= 1")
    scaled, ranges = minmax_scale(df.select(idx, *cols), cols)
    sw = supervised_windows(scaled, cols, order, horizon, split=10 ** 18, idx=idx)
    feats = cols + [f"{c}_lag{k}" for k in range(1, order + 1) for c in cols]
    # every row joins the bootstrap draws its hash selects; one Gram per draw
    # over [1, features, all targets] (a single aggregate) gives every draw's
    # least-squares fit for all outputs at once
    targets = [f"{v}_lead{h}" for h in range(1, horizon + 1) for v in cols]
    thr = int(fraction * 1000)
    member = F.array(*[F.when((F.abs(F.xxhash64(F.col(idx), F.lit(seed + d))) % 1000) < thr, F.lit(d))
                       for d in range(draws)])
    bag = sw.select(F.explode(F.array_compact(member)).alias("_draw"), *feats, *targets)
    z = [F.lit(1.0)] + [F.col(c).cast("double") for c in feats + targets]
    grams = {r["_draw"]: r for r in gram(bag, z, ["_draw"]).collect()}       # draws rows, model-sized
    nx, m = 1 + len(feats), len(z)
    coefs = []                                  # draws x horizon x K (intercept, weights)
    for d in range(draws):
        r = grams[d]
        beta, _, _ = ols_from_gram(unpack(r["g"], m), range(nx), range(nx, m), int(r["n"]))
        per_h = []
        for h in range(horizon):
            per_h.append([(float(beta[0, h * len(cols) + i]), beta[1:, h * len(cols) + i]) for i in range(len(cols))])
        coefs.append(per_h)
    n = df.agg(F.max(idx)).first()[0]
    last = scaled.where(F.col(idx) > n - order - 1).orderBy(idx).collect()        # order+1 rows
    hist = [np.array([r[c] for c in cols], dtype=float) for r in last]
    K = len(cols)
    n_iter = steps - horizon + 1
    acc_m = [[[] for _ in range(K)] for _ in range(steps)]
    acc_s = [[[] for _ in range(K)] for _ in range(steps)]
    for it in range(n_iter):
        x = np.concatenate([hist[-1]] + [hist[-1 - k] for k in range(1, order + 1)])
        outs = np.array([[[b + w @ x for (b, w) in per_var] for per_var in per_h] for per_h in coefs])  # D x H x K
        mean, sd = outs.mean(axis=0), outs.std(axis=0)
        for h in range(horizon):
            for i in range(K):
                acc_m[it + h][i].append(mean[h, i])
                acc_s[it + h][i].append(sd[h, i])
        hist.append(mean[0])
    recs = []
    for s_ in range(steps):
        for i, v in enumerate(cols):
            lo, hi = ranges[v]
            rng = (hi - lo) if hi != lo else 1.0
            back = lambda z: (z + 1.0) / 2.0 * rng + lo
            mu, sd = float(np.mean(acc_m[s_][i])), float(np.mean(acc_s[s_][i]))
            recs.append((v, int(n + 1 + s_), float(back(mu)), float(back(mu - 2 * sd)), float(back(mu + 2 * sd))))
    return df.sparkSession.createDataFrame(recs, f"variable string, {idx} long, mean double, lower double, upper double")


def sensitivity(model, data: DataFrame, feats: Sequence[str], eps: float = 1e-3) -> DataFrame:
    """Input sensitivity: central finite difference of the prediction for
    each input feature, averaged over all rows (distributed transforms)."""
    rows = []
    for i, f in enumerate(feats):
        def shifted(delta):
            d = data.withColumn(f, F.col(f) + F.lit(delta))
            return VectorAssembler(inputCols=list(feats), outputCol="features").transform(d.drop("features"))
        up = model.transform(shifted(eps)).agg(F.avg("prediction")).first()[0]
        dn = model.transform(shifted(-eps)).agg(F.avg("prediction")).first()[0]
        rows.append((f, (up - dn) / (2 * eps)))
    return data.sparkSession.createDataFrame(rows, "feature string, sensitivity double")


# ------------------------------------------------------ N8 window classifier

def window_classifier(df: DataFrame, subject: str, visit: str, inputs: Sequence[str], target: str,
                      window: int, test_subjects: DataFrame, iters: Sequence[int] = (5, 10, 20, 35, 50),
                      hidden: Sequence[int] = (16,), seed: int = 42) -> DataFrame:
    """Per-subject windows (T11: global scaling, lags never cross
    subjects, missing lags -> 0), subject hold-out split (P6), multilayer
    perceptron; accuracy on train and held-out subjects for each number of
    iterations in ``iters``.  Output: (max_iter, accuracy, val_accuracy)."""
    from .transform import subject_split, subject_windows
    levels = bounded_distinct(df, target, 1000)
    lab = _code(F.col(target), levels)
    base = df.select(subject, visit, *inputs, lab.alias("label")).where(F.col("label").isNotNull())
    w = subject_windows(base, subject, visit, inputs, "label", window)
    w = w.fillna(0.0, subset=list(inputs))
    feats = list(inputs) + [f"{c}_lag{k}" for k in range(1, window) for c in inputs]
    data = VectorAssembler(inputCols=feats, outputCol="features").transform(subject_split(w, subject, test_subjects))
    data = cut_lineage(data)
    train, val = data.where(F.col("set") == "train"), data.where(F.col("set") == "test")
    out = []
    for it in iters:
        mlp = MultilayerPerceptronClassifier(layers=[len(feats), *hidden, len(levels)], maxIter=it, seed=seed,
                                             featuresCol="features", labelCol="label")
        m = mlp.fit(train)
        acc = m.transform(train).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        vac = m.transform(val).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        out.append((int(it), float(acc or 0.0), float(vac) if vac is not None else None))
    return df.sparkSession.createDataFrame(out, "max_iter int, accuracy double, val_accuracy double")


# --------------------------------------------------- N9-N11 dynamic model

def decayed_trace(df: DataFrame, cols: Sequence[str], visit: str, subject: str, delay: int, decay: float,
                  size: int | None = None) -> DataFrame:
    """Eligibility trace a_t = decay * a_{t-1} + x_{t-delay} per subject (0
    before the first value), as a blocked scan: within a block the running sum
    of x_s / decay^s, times decay^t, and between the blocks of a subject a carry.
    A block is as long as its weights stay within 1e150, ``size`` rows at most."""
    cols = list(cols)
    size = block_size(df.sparkSession, size)
    block = size if not 0 < decay < 1 else max(1, min(size, int(150 * math.log(10) / -math.log(decay))))
    src = lagged(df, cols, lags=[delay], idx=visit, keys=[subject], size=size) if delay > 0 else df
    src_cols = [f"{c}_lag{delay}" if delay > 0 else c for c in cols]
    src = src.fillna(0.0, subset=src_cols)
    names = [f"{c}_trace" for c in cols]
    if decay == 0:
        return src.select("*", *[F.col(c).cast("double").alias(t) for c, t in zip(src_cols, names)])
    w = Window.partitionBy(subject, BLK).orderBy(visit)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = by_block(add_blocks(src, visit, block).drop(HALO), [subject]).withColumn("_row", F.row_number().over(w))
    local = [(F.sum(F.col(c) * F.pow(F.lit(decay), -F.col("_row"))).over(upto) * F.pow(F.lit(decay), F.col("_row"))).alias(t)
             for c, t in zip(src_cols, names)]
    b = b.select("*", *local)
    last = df.agg(F.max(visit)).first()[0]      # one number
    if last is None or last < block:            # no subject has a second block
        return b.drop(BLK, "_row")
    ends = b.groupBy(subject, BLK).agg(F.max("_row").alias("_len"), F.max_by(F.array(*names), "_row").alias("_end"))

    def carry(table, starts):
        end, length, first = matrix(table.column("_end")), table.column("_len").to_pylist(), set(starts.tolist())
        out = np.zeros_like(end)
        for i in range(1, len(end)):
            if i not in first:
                out[i] = out[i - 1] * decay ** length[i - 1] + end[i - 1]
        return {subject: table.column(subject), BLK: table.column(BLK), "_carry": arrays(out)}

    kt = dict(df.dtypes)[subject]
    carries = map_groups(ends, [subject], [BLK], carry, f"`{subject}` {kt}, {BLK} long, _carry array<double>")
    j = b.join(carries.where(F.col(BLK) > 0), [subject, BLK], "left")
    more = [F.coalesce(F.col("_carry")[i] * F.pow(F.lit(decay), F.col("_row")), F.lit(0.0)) for i in range(len(cols))]
    return j.select(*[F.col(c) for c in src.columns], *[(F.col(t) + m).alias(t) for t, m in zip(names, more)])


def dynamic_classifier(df: DataFrame, subject: str, visit: str, inputs: Sequence[str], target: str,
                       delay: int = 2, decay: float = 0.5, test_subjects: DataFrame | None = None,
                       max_iter: int = 50):
    """Next-step classification of ``target`` from one-hot inputs at
    lags 1..delay-1 plus an exponentially decayed trace of older inputs; a step
    with a missing input has none of its levels, and one before a missing
    target is no example
    (the DyBM conditional is logistic in these features); multinomial
    logistic regression.  Returns (metrics, per-subject results, weights):
    recall = share of correct argmax predictions (N10), group_correct =
    per-subject mode of predictions equals mode of actuals, weights averaged
    over lags (N11)."""
    require(delay >= 2, "delay >= 2")
    require(0.0 <= decay <= 1.0, "decay in [0, 1]")
    enc = df.withColumn("_target", F.col(target))
    feat_base = []
    for c in inputs:
        enc, names = one_hot(enc, c)
        if names == [c]:
            vals = bounded_distinct(df, c, 2)
            enc = enc.withColumn(c, (F.col(c) == F.lit(vals[-1])).cast("double") if vals else F.lit(0.0))
        else:                                   # a missing input is a step without any level
            known = len(bounded_distinct(df, c, 1000))
            enc, names = enc.drop(*names[known:]), names[:known]
        feat_base += names
    enc = enc.fillna(0.0, subset=feat_base)
    levels = bounded_distinct(df, target, 1000)
    # label = the next visit's target; features = current/past inputs
    def steps(w):
        return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in feat_base for k in range(1, delay)} | {"_target_lead1": F.lead("_target", 1).over(w)}
    lg = halo_window(enc.select(subject, visit, *feat_base, "_target"), steps, visit, [subject], before=delay - 1, after=1)
    lag_cols = [f"{c}_lag{k}" for k in range(1, delay) for c in feat_base]
    tr = decayed_trace(lg, feat_base, visit, subject, delay, decay)
    label = _code(F.col("_target_lead1"), levels)
    feats = feat_base + lag_cols + [f"{c}_trace" for c in feat_base]
    data = tr.fillna(0.0, subset=lag_cols).withColumn("label", label).where(F.col("label").isNotNull())
    data = VectorAssembler(inputCols=feats, outputCol="features").transform(data)
    if test_subjects is not None:
        from .transform import subject_split
        data = subject_split(data, subject, test_subjects)
    else:
        data = data.withColumn("set", F.lit("train"))
    data = cut_lineage(data)
    model = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=max_iter,
                               regParam=1e-4).fit(data.where(F.col("set") == "train"))
    pred = model.transform(data)
    metrics = pred.groupBy("set").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("recall"),
                                      F.count(F.lit(1)).alias("n"))
    # per-subject mode of predictions vs mode of actuals (smallest class on ties)
    def mode(col):
        c = pred.groupBy(subject, col).count()
        w = Window.partitionBy(subject).orderBy(F.desc("count"), F.asc(col))
        return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(subject, F.col(col).alias(f"mode_{col}"))
    per_subject = mode("prediction").join(mode("label"), subject).withColumn(
        "group_correct", (F.col("mode_prediction") == F.col("mode_label")).cast("int"))
    W = model.coefficientMatrix.toArray()
    rows = []
    for o, lv in enumerate(levels):
        for j, f in enumerate(feats):
            base = f.rsplit("_lag", 1)[0] if "_lag" in f else f.replace("_trace", "")
            rows.append((str(lv), base, f, float(W[o, j])))
    wdf = df.sparkSession.createDataFrame(rows, "output string, input string, feature string, weight double")
    weights = wdf.where(~F.col("feature").endswith("_trace")).groupBy("output", "input").agg(
        F.avg("weight").alias("weight"))
    return metrics, per_subject, weights


# ------------------------------------------------------------- N12 RBM

def _hashed_uniform(row: np.ndarray, units: int, draw: int) -> np.ndarray:
    """Numbers in [0, 1) from a hash of (row, unit, draw)."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = row[:, None] + np.arange(1, units + 1, dtype=np.uint64)[None, :] * odd + np.uint64(draw + 1) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53


def rbm_structure(encoded: DataFrame, n_hidden: int, n_iter: int = 10, learning_rate: float = 0.1,
                  seed: int = 42, row_id: str | None = None, batch: int = 10, shard_rows: int = 2000) -> DataFrame:
    """Bernoulli RBM trained by contrastive divergence (CD-1) in
    ``n_iter`` epochs of mini-batches of ``batch`` rows.  A hash of the row deals
    the rows to shards of about ``shard_rows``; in every epoch each shard runs
    all its mini-batches, in the order of the hash, from the weights of the last
    epoch, and the shards' weights are averaged by rows (with one shard that is
    plain mini-batch training).  A unit's draw is a hash of (row, unit, epoch,
    seed), so the result does not depend on the partitioning; the row is
    ``row_id`` (not a column of the model) or, without one, the row's place in
    the order of the values.  Output: (hidden, column, weight)."""
    require(n_hidden >= 1 and n_iter >= 1 and 0 < learning_rate <= 1, "invalid RBM parameters")
    cols = [c for c in encoded.columns if c != row_id]
    require(len(cols) >= 2, "RBM needs two or more encoded columns")
    nv = len(cols)
    rng = np.random.default_rng(seed)
    W = rng.normal(0, 0.01, size=(n_hidden, nv))
    bh, bv = np.zeros(n_hidden), np.zeros(nv)
    if row_id is None:
        encoded = dense_index(encoded, cols, idx="_place")
    data = cut_lineage(encoded.select(*[F.col(c).cast("double").alias(c) for c in cols],
                                      F.xxhash64(row_id or "_place").alias("_row_key")))
    n = data.count()
    data = data.withColumn("_shard", F.pmod(F.xxhash64("_row_key", F.lit(seed)), F.lit(-(-max(n, 1) // shard_rows))))
    size = n_hidden * nv + n_hidden + nv

    def training(W0, bh0, bv0, s):
        def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
            W, bh, bv = W0.copy(), bh0.copy(), bv0.copy()
            pdf = pdf.sort_values("_row_key")
            rows = pdf[cols].to_numpy(dtype=float)
            row = pdf["_row_key"].to_numpy(np.int64).view(np.uint64)
            draw_h, draw_v = _hashed_uniform(row, n_hidden, 2 * s), _hashed_uniform(row, nv, 2 * s + 1)
            for lo in range(0, len(rows), batch):
                V = rows[lo:lo + batch]
                ph = 1 / (1 + np.exp(-(V @ W.T + bh)))
                h = (draw_h[lo:lo + batch] < ph).astype(float)
                pv = 1 / (1 + np.exp(-(h @ W + bv)))
                v2 = (draw_v[lo:lo + batch] < pv).astype(float)
                ph2 = 1 / (1 + np.exp(-(v2 @ W.T + bh)))
                step = learning_rate / len(V)
                W += step * (ph.T @ V - ph2.T @ v2)
                bh += step * (ph.sum(0) - ph2.sum(0))
                bv += step * (V.sum(0) - v2.sum(0))
            return pd.DataFrame({"k": np.arange(size), "v": np.concatenate([W.ravel(), bh, bv]) * len(rows)})
        return epoch

    for it in range(n_iter if n else 0):
        g = data.groupBy("_shard").applyInPandas(training(W, bh, bv, seed + it), "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
        mean = np.zeros(size)
        for r in g.collect():                 # one number per weight: model-sized, not data-sized
            mean[r["k"]] = r["v"] / n
        W, bh, bv = mean[:n_hidden * nv].reshape(n_hidden, nv), mean[n_hidden * nv:n_hidden * nv + n_hidden], mean[n_hidden * nv + n_hidden:]
    rows = [(int(h), cols[j], float(W[h, j])) for h in range(n_hidden) for j in range(nv)]
    return encoded.sparkSession.createDataFrame(rows, "hidden int, column string, weight double")

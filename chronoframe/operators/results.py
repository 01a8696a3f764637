"""Result shaping: overlapping multi-step predictions, draw intervals,
criterion minima, model leaderboard, forecast plot tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import _cols
from .validate import bounded_distinct, require


def overlap_average(preds: DataFrame, idx: str, pred: str, variable: str | None = None,
                    keys=()) -> DataFrame:
    """Row ``i`` holds predictions for ``i+1 .. i+h`` in an array; all
    predictions of the same target step are averaged."""
    k = _cols(keys)
    e = preds.select(*k, idx, F.posexplode(pred).alias("_pos", "_p"))
    out = e.groupBy(*k, (F.col(idx) + F.col("_pos") + 1).alias(idx)).agg(
        F.avg("_p").alias("predicted"), F.count(F.lit(1)).alias("n_predictions"))
    if variable is not None:
        out = out.select(F.lit(variable).alias("variable"), "*")
    return out


def draw_interval(draws: DataFrame, keys: Sequence[str], value: str = "value", width: float = 2.0) -> DataFrame:
    """Mean +- ``width`` population standard deviations over stochastic draws."""
    g = list(keys)
    return draws.groupBy(*g).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd")).select(
        *g, "mean", (F.col("mean") - width * F.col("_sd")).alias("lower"),
        (F.col("mean") + width * F.col("_sd")).alias("upper"))


def walk_order(limit_p: int, limit_q: int, p: str = "p", q: str = "q") -> F.Column:
    """F8: rank of a grid cell along the anti-diagonal walk: diagonals by
    p+q; within a diagonal the cell with the larger max(p, q) first, then
    larger p first."""
    return F.struct((F.col(p) + F.col(q)).alias("_d"), (-F.greatest(F.col(p), F.col(q))).alias("_g"),
                    (-F.col(p)).alias("_p"))


def running_minima(grid: DataFrame, criteria: Sequence[str], order: Sequence, keys=()) -> DataFrame:
    """along the walk order, keep the cells that set a new strict
    minimum of each criterion.  Output (keys, criterion, step, params.., value)."""
    k = _cols(keys)
    rows = []
    for c in criteria:
        w = Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        prev = F.min(c).over(w)
        t = grid.select("*", prev.alias("_prev")).where(F.col("_prev").isNull() | (F.col(c) < F.col("_prev")))
        rows.append(t.select(*k, F.lit(c).alias("criterion"), *[x for x in grid.columns if x not in k and x not in criteria],
                             F.col(c).alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def leaderboard(mae_df: DataFrame, lb_share: DataFrame, keys=("model", "variable")) -> DataFrame:
    """MAE per model/variable joined with the Ljung-Box residual verdict."""
    k = list(keys)
    j = mae_df.join(lb_share, k, "left")
    return j.select(F.concat_ws(" - ", *[F.col(x) for x in k]).alias("label"), *k, "mae",
                    F.col("all_lags_below"), F.when(F.col("all_lags_below") == 1, "red").otherwise("green").alias("colour"))


def upsert_results(current: DataFrame, new: DataFrame, keys=("model", "variable"), test_size: str = "test_size",
                   reset_gap: int = 2) -> DataFrame:
    """keep one result per model/variable; all stored results are reset
    when the new test size differs by more than ``reset_gap`` rows."""
    k = list(keys)
    new_size = new.agg(F.max(test_size)).first()[0]
    kept = current.where(F.abs(F.col(test_size) - F.lit(new_size)) <= reset_gap)
    kept = kept.join(new.select(*k), k, "left_anti")
    return kept.unionByName(new)


def forecast_plot_table(observed: DataFrame, predicted: DataFrame, forecast: DataFrame | None,
                        idx: str = "idx", keys=("variable",)) -> DataFrame:
    """Tagged long rows (idx, kind, value, lower, upper)."""
    k = list(keys)
    parts = [observed.select(*k, idx, F.lit("observed").alias("kind"), F.col("value"),
                             F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")),
             predicted.select(*k, idx, F.lit("predicted").alias("kind"), F.col("predicted").alias("value"),
                              F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))]
    if forecast is not None:
        parts.append(forecast.select(*k, idx, F.lit("forecast").alias("kind"), F.col("mean").alias("value"),
                                     "lower", "upper"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forecast_wide(fc: DataFrame, variables: Sequence[str], idx: str = "idx") -> DataFrame:
    """Long forecast rows (variable, idx, mean, lower, upper) reshaped to
    one row per step with ``var``, ``var_lower_conf``, ``var_upper_conf``."""
    vs = list(variables)
    aggs = []
    for v in vs:
        hit = F.col("variable") == F.lit(v)
        aggs += [F.max(F.when(hit, F.col("mean"))).alias(v),
                 F.max(F.when(hit, F.col("lower"))).alias(f"{v}_lower_conf"),
                 F.max(F.when(hit, F.col("upper"))).alias(f"{v}_upper_conf")]
    return fc.groupBy(idx).agg(*aggs)


def join_bands(mean: DataFrame, lower: DataFrame, upper: DataFrame, idx: str = "idx", keys=()) -> DataFrame:
    """A forecast with its lower and upper frames, joined by series and
    position; steps that one of them lacks are dropped.  Every frame has one
    column besides the keys and ``idx``."""
    on = [*_cols(keys), idx]

    def named(df, name):
        rest = [c for c in df.columns if c not in on]
        require(len(rest) == 1, "a band frame has one value column")
        return df.select(*on, F.col(rest[0]).alias(name))
    return named(mean, "mean").join(named(lower, "lower"), on).join(named(upper, "upper"), on)


def observed_and_fitted(observed: DataFrame, fitted: DataFrame, idx: str = "idx", keys=()) -> DataFrame:
    """Every observation with the fitted value of its position, NULL where
    the fitted frame is shorter."""
    on = [*_cols(keys), idx]
    return observed.join(fitted, on, "left")


def ordered_pairs(df: DataFrame, col: str, limit: int = 1000) -> DataFrame:
    """All ordered pairs of the distinct values of ``col`` (source, target),
    from one array of at most ``limit`` values."""
    values = F.array(*[F.lit(v) for v in bounded_distinct(df, col, limit)])
    kind = df.schema[col].dataType.simpleString()
    one = df.sparkSession.range(1).select(values.cast(f"array<{kind}>").alias("v"))
    return one.select(F.explode("v").alias("source"), "v").select("source", F.explode("v").alias("target"))

"""train + walk-forward + errors + residuals + forecast in one call,
with the preconditions the reference's UI enforces (SURVEY 2.13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear as ln
from .diagnostics import V, mae
from .validate import require, require_complete


def run_forecast(df: DataFrame, cols: Sequence[str], model: str, split: int, p: int = 1,
                 order: tuple = (1, 0, 0), seasonal: tuple | None = None, forecast_window: int | None = None,
                 idx: str = "idx", alpha: float = 0.05, trend: str | None = None) -> dict:
    """Returns {'predictions', 'errors', 'coefficients', 'forecast'} DataFrames.

    model='var': VAR(p) over >= 2 variables, prefix-Gram walk-forward (refit at
    every test step), coefficients refitted on all rows, h-step forecast.
    model='sarimax': one variable, no constant unless ``trend`` is 'c'; every
    test row is predicted by a refit on the rows before it (see
    :func:`linear.sarima_one_step`).  The forecast
    always comes from a refit on all rows (the reference forecast from a model
    that had not seen the last test row)."""
    cols = list(cols)
    require(split >= 10, "split must be >= 10")
    require(forecast_window is None or forecast_window >= 1, "forecast window must be >= 1")
    require_complete(df, cols, "model training")
    if model == "var":
        require(len(cols) >= 2, "VAR needs two or more variables")
        require(p >= 0, "p must be >= 0")
        preds = ln.walk_forward(df, cols, p, split, idx=idx)
        coefs = ln.var_fit(df, cols, p, idx=idx)
        fc = ln.var_forecast(df, cols, coefs, p, forecast_window, idx=idx, alpha=alpha) if forecast_window else None
    elif model == "sarimax":
        require(len(cols) == 1, "SARIMAX takes exactly one variable")
        require(all(v >= 0 for v in order), "p, d, q must be >= 0")
        require(seasonal is None or all(v >= 0 for v in seasonal), "seasonal orders must be >= 0")
        col = cols[0]
        long_y = df.select(idx, F.col(col).cast("double").alias("value"))
        preds = ln.sarima_one_step(long_y, order, seasonal, split, idx, trend=trend)
        preds = preds.select(F.lit(col).alias(V), idx, "observed", "predicted", "residual")
        coefs, fc = ln.sarima(long_y, order, seasonal, steps=forecast_window or 0, alpha=alpha, idx=idx, trend=trend)
        if fc is not None:
            fc = fc.select(F.lit(col).alias(V), "*")
    else:
        raise ValueError(f"unknown model {model!r}")
    return {"predictions": preds, "errors": mae(preds), "coefficients": coefs, "forecast": fc}

"""The registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package
from . import oracle, queries as q

_SQL_CHECKED = [
    "flagship_diff_acf", "hourly_resample", "daily_series", "hourly_missing_profile", "ld_missing_profile",
    "missing_indices", "column_summary", "subject_missing", "locf", "locf_nocb", "nearest_mean",
    "linear_interpolate", "imputation_sets", "difference2", "reverse_difference", "minmax_scale",
    "bin_equal_width", "label_encode", "one_hot", "subject_windows", "supervised_windows", "temporal_split",
    "subject_split", "acf_bartlett", "seasonal_decompose", "fisher_g", "durbin_watson", "residual_histogram",
    "mae_naive", "overlap_average", "csv_roundtrip", "ld_csv_roundtrip",
    "rbm_encode", "replace_values", "subjects",
    "ld_nearest_mean", "ld_difference", "ld_acf", "seasonal_decompose_mult",
    "ld_interpolate", "ljung_box_naive", "bh_ljung_box",
    "big_key_index", "one_hot_levels", "adf_users", "granger_lag1", "segment_ar1", "active_customers", "csv_names",
    "minmax_roundtrip", "acf_display", "naive_residuals", "accepted_imputation", "drop_sparse_columns",
    "incomplete_columns", "event_value_bands", "record_lows", "observed_and_predicted", "transposed_days",
    "user_ar1_forecast", "user_model_impute", "joined_bands", "observed_fitted", "type_pairs", "forecast_input", "user_options",
    "complete_columns", "granger_edges", "granger_causes", "lag_links", "residual_verdicts",
    "naive_leaderboard", "order_walk", "band_table", "stored_results", "rbm_encode_all",
]

_NUMERIC = [
    "pacf", "adf", "stationarity", "granger_tests", "granger_network", "var_fit", "var_select_order",
    "var_param_minima", "var_walk_forward", "ar_walk_forward", "var_forecast", "ljung_box", "leaderboard",
    "arima_fit", "arma_grid_minima", "box_cox",
    "model_impute", "chained_impute", "forest_impute", "window_regression", "nn_forecast",
    "window_classifier", "dynamic_classifier", "dynamic_groups", "dynamic_weights", "rbm_structure", "pcmci",
    "imputation_check", "arima_forecast", "sarima_fit", "granger_by_variable",
    "arima_likelihood", "spline_hourly", "ld_spline", "user_arma_fit", "segment_seasonal_grid", "segment_sarima_forecast", "segment_var_forecast",
    "segment_walk_forward", "forecast_table", "sarimax_process", "var_process",
]


def _wrap(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _wrap(getattr(q, name)) for name in _SQL_CHECKED + _NUMERIC}


def oracle_sql() -> dict[str, str]:
    sql = oracle.oracle_sql()
    return {k: v for k, v in sql.items() if k in set(_SQL_CHECKED)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return q.flagship_diff_acf(spark, sf_dir)

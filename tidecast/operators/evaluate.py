"""Alignment of forecasts with the truth, and error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalars import is_finite, scale_col
from tidecast.operators.features import TEST, in_split, only_train, series
from tidecast.operators.forecasts import MODEL_KEYS, tagged

METRICS = ["rmse", "mae", "mase", "smape", "rmse_norm", "mae_norm"]


def with_seasonal_lag(prepared: DataFrame, period: int = 7) -> DataFrame:
    """Add `seasonal_lag`, the filled sales `period` rows back, and how far sales moved since."""
    lagged = prepared.withColumn("seasonal_lag", F.lag("sales", period).over(in_split()))
    return lagged.withColumn("seasonal_change", F.abs(F.col("sales") - F.col("seasonal_lag")))


def mase_scale(prepared: DataFrame, period: int = 7) -> DataFrame:
    """Mean seasonal change of the training split; NULL if it is too short or never changes."""
    mean_change = F.avg(only_train(F.col("seasonal_change")))
    return with_seasonal_lag(prepared, period).groupBy("category").agg(
        F.nullif(mean_change, F.lit(0.0)).alias("mase_scale")
    )


def truth_table(prepared: DataFrame, max_lag: int, period: int = 7, min_history: int = 7) -> DataFrame:
    """Observed test targets on the common evaluation dates, with both scales and the MASE scale.

    All windows reuse the shuffle and the sort of `prepare_features`. The seasonal lag of each row
    comes along, so the seasonal-naive forecast needs no join with its truth.
    """
    mean_change = F.avg(only_train(F.col("seasonal_change"))).over(series())
    rows = with_seasonal_lag(prepared, period).withColumn(
        "mase_scale", F.nullif(mean_change, F.lit(0.0))
    )
    first = max(max_lag, min_history)
    scored = rows.filter((F.col("split") == TEST) & (F.col("pos") > first) & F.col("target_observed"))
    low, high = F.col("sales_min"), F.col("sales_max")
    return scored.select(
        "category", "date", F.col("sales").alias("target"),
        scale_col(F.col("sales"), low, high).alias("target_norm"),
        "mase_scale", "seasonal_lag",
        scale_col(F.col("seasonal_lag"), low, high).alias("seasonal_lag_norm"),
    )


def naive_aligned(truth: DataFrame) -> DataFrame:
    """Seasonal-naive rows beside their truth, taken from the truth table itself."""
    forecast = truth.filter(F.col("seasonal_lag").isNotNull()).withColumns(
        {"predicted": F.col("seasonal_lag"), "predicted_norm": F.col("seasonal_lag_norm")}
    )
    truth_columns = ["target", "target_norm", "mase_scale"]
    return tagged(forecast, "seasonal_naive", keep=truth_columns)


def align(forecasts: DataFrame, truth: DataFrame, eval_dates: DataFrame | None = None) -> DataFrame:
    """Inner join with the truth on (category, date), kept to the common dates if these are given."""
    truth = truth.drop("seasonal_lag", "seasonal_lag_norm")
    aligned = truth.join(forecasts, ["category", "date"], "inner")
    return aligned if eval_dates is None else aligned.join(eval_dates, ["category", "date"], "left_semi")


def predictions_table(aligned: DataFrame) -> DataFrame:
    return aligned.select(
        *MODEL_KEYS, "date", F.col("target").alias("actual"), "predicted",
        F.col("target_norm").alias("actual_norm"), "predicted_norm",
    )


def error_aggregates(actual: str, predicted: str, actual_norm: str, predicted_norm: str) -> list:
    """RMSE, MAE, sMAPE, n and the normalised errors over finite pairs, as aggregate columns."""

    def errors(a, p):
        return F.when(is_finite(F.col(a)) & is_finite(F.col(p)), F.col(p) - F.col(a))

    error, error_norm = errors(actual, predicted), errors(actual_norm, predicted_norm)
    size = (F.abs(F.col(actual)) + F.abs(F.col(predicted))) / 2
    term = F.when(error.isNotNull(), F.when(size > 0, F.abs(error) / size).otherwise(F.lit(0.0)))
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(term) * 100).alias("smape"),
        F.count(error).alias("n"),
        F.sqrt(F.avg(error_norm * error_norm)).alias("rmse_norm"),
        F.avg(F.abs(error_norm)).alias("mae_norm"),
    ]


def metrics_table(aligned: DataFrame, on_empty: str = "raise") -> DataFrame:
    """One row per (category, model, variant, backend, seed), all models in one aggregation.

    A group without a single finite pair stops the job (`"raise"`) or keeps NULL metrics (`"null"`).
    """
    measured = aligned.groupBy(*MODEL_KEYS).agg(
        *error_aggregates("target", "predicted", "target_norm", "predicted_norm"),
        F.max("mase_scale").alias("mase_scale"),
    )
    if on_empty == "raise":
        finite = F.when(F.col("n") > 0, True).otherwise(
            F.raise_error(F.lit("No finite prediction pairs are available")).cast("boolean")
        )
        measured = measured.filter(finite)
    mase = F.try_divide(F.col("mae"), F.col("mase_scale"))
    return measured.select(
        *MODEL_KEYS, "rmse", "mae", mase.alias("mase"), "smape", "n", "rmse_norm", "mae_norm"
    )

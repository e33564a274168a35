"""The long forecast table shared by all models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalars import scale_col, unscale_col

BACKEND = "spark"
FUZZY_BACKEND = "spark-it2"
MODEL_KEYS = ["category", "model", "variant", "backend", "seed"]
FORECAST_COLUMNS = [*MODEL_KEYS, "date", "predicted", "predicted_norm"]


def tagged(
    forecast: DataFrame,
    model: str,
    variant: str | Column = "sales_only",
    backend: str = BACKEND,
    seed: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Give a forecast its model keys; models without a random start have a NULL seed."""
    variant = variant if isinstance(variant, Column) else F.lit(variant)
    seed = F.lit(None) if seed is None else seed
    return forecast.select(
        "category", F.lit(model).alias("model"), variant.alias("variant"),
        F.lit(backend).alias("backend"), seed.cast("long").alias("seed"),
        "date", "predicted", "predicted_norm", *(keep or []),
    )


def to_both_scales(forecast: DataFrame) -> DataFrame:
    """Fill in whichever of `predicted` and `predicted_norm` is absent from the series scale."""
    low, high = F.col("sales_min"), F.col("sales_max")
    if "predicted" not in forecast.columns:
        return forecast.withColumn("predicted", unscale_col(F.col("predicted_norm"), low, high))
    return forecast.withColumn("predicted_norm", scale_col(F.col("predicted"), low, high))

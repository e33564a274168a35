"""Model tables with a digest of their arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.forecasts import FUZZY_BACKEND
from tidecast.sources.demand import write_table


def model_digest() -> Column:
    arrays = F.struct("feature_columns", "mfs", "memberships", "rules", "fallback")
    return F.sha2(F.to_json(arrays), 256)


def stamped(models: DataFrame) -> DataFrame:
    return models.withColumns({
        "schema_version": F.lit(1), "backend": F.lit(FUZZY_BACKEND),
        "model_type": F.lit("interval_type2_zero_order_sugeno"), "model_sha256": model_digest(),
    })


def save_models(models: DataFrame, path: str) -> None:
    write_table(stamped(models), path)


def checked(models: DataFrame) -> DataFrame:
    """Models whose backend and digest hold; any other row stops the job that reads it."""
    right_backend = F.col("backend") == FUZZY_BACKEND
    whole = F.col("model_sha256") == model_digest()
    wrong = F.when(~right_backend, "Not a model of this backend").otherwise("Model array hash mismatch")
    holds = right_backend & whole
    return models.filter(F.when(holds, True).otherwise(F.raise_error(wrong).cast("boolean")))


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return checked(spark.read.parquet(path))

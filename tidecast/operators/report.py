"""Tables behind charts and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.summaries import with_backend


def forecast_lines(predictions: DataFrame) -> DataFrame:
    """Forecast per date averaged over seeds."""
    return (
        with_backend(predictions).groupBy("category", "date", "model", "variant", "backend")
        .agg(F.avg("predicted").alias("predicted"))
    )


def actual_line(predictions: DataFrame) -> DataFrame:
    """The actual per (category, date): equal in all rows of the key, so `min` picks it."""
    return predictions.groupBy("category", "date").agg(F.min("actual").alias("actual"))


def series_label():
    return F.concat_ws(":", "model", "variant", "backend")


def forecast_pivot(
    predictions: DataFrame, series: list[str], category: str | None = None
) -> DataFrame:
    """Date x series table of mean forecasts beside the actual, for one category or for all.

    `series` lists the `model:variant:backend` labels of the run (its configuration bounds them).
    Actual and series share the key, so one aggregation replaces an outer join of the two.
    """
    rows = with_backend(predictions).withColumn("series", series_label())
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    lines = [F.avg(F.when(F.col("series") == s, F.col("predicted"))).alias(s) for s in series]
    return rows.groupBy("category", "date").agg(F.min("actual").alias("actual"), *lines)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """First rows by category and date: a distributed top-k."""
    return df.orderBy(F.col("category").asc_nulls_last(), F.col("date").asc_nulls_last()).limit(n)

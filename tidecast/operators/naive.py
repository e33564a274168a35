"""Seasonal-naive forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.features import TEST, in_split
from tidecast.operators.forecasts import tagged, to_both_scales


def seasonal_naive(prepared: DataFrame, period: int = 7) -> DataFrame:
    """Filled sales `period` rows back inside the test split, for observed targets."""
    test = prepared.filter(F.col("split") == TEST)
    lagged = test.select(
        "category", "date", "pos", "target_observed", "sales_min", "sales_max",
        F.lag("sales", period).over(in_split()).alias("predicted"),
    )
    scored = lagged.filter(F.col("target_observed") & (F.col("pos") > period))
    return tagged(to_both_scales(scored), "seasonal_naive")

"""Forms in which both engines' results are compared.

Sums run in another order per engine, so computed doubles are compared at a fixed number of
decimals; dates are compared as ISO text, which no client library turns into timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMALS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at the compared decimals, dates as ISO text."""

    def shown(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            return F.round(column, DECIMALS).alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(column, "yyyy-MM-dd").alias(field.name)
        return column

    return df.select(*[shown(field) for field in df.schema])


def r(expression: str, alias: str) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"round({expression}, {DECIMALS}) + cast(0 as double) as \"{alias}\""


def rs(names: list[str]) -> str:
    return ", ".join(r(f'"{n}"', n) for n in names)

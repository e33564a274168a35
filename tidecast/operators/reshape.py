"""Legacy wide demand table -> canonical long table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalars import strip
from tidecast.operators.contract import coerce

# Wide-table covariate headings and their canonical names.
WIDE_COVARIATES = {
    "AVG temp": "avg_temp",
    "MAX temp": "max_temp",
    "MIN temp": "min_temp",
    "Humidity": "humidity",
    "Rainfall": "rainfall",
}
# Wide column heading and the category rename.
SALES_HEADING = re.compile(r"^(\d{4})\s+(.+?)\s+sales$")
RENAMED_CATEGORY = ("insecticide control", "insect repellent")


def wide_to_long(df: DataFrame) -> DataFrame:
    """One long row per input row and `<yyyy> <category> sales` column. Row-local: no join, no shuffle."""
    if "Date" not in df.columns:
        raise ValueError("Wide table without a column named Date")
    found = [(name, SALES_HEADING.match(name)) for name in df.columns]
    sales = [(name, m.group(1), m.group(2).strip().replace(*RENAMED_CATEGORY)) for name, m in found if m]
    if not sales:
        raise ValueError("Wide table without a column named like '2016 water sales'")

    def text_of(name: str) -> Column:
        return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")

    # Headings are read once, by the driver: each cell is a struct of columns and constants.
    cells = [
        F.struct(
            F.lit(year).alias("year"), F.lit(category).alias("category"), text_of(name).alias("sales"),
            *[text_of(f"{year} {heading}").alias(canonical) for heading, canonical in WIDE_COVARIATES.items()],
        )
        for name, year, category in sales
    ]
    long = df.select(strip(F.col("Date").cast("string")).alias("day"), F.inline(F.array(*cells)))
    day_first = F.try_to_timestamp(F.concat("day", F.lit("/"), "year"), F.lit("d/M/yyyy"))
    return coerce(long.select(day_first.cast("date").alias("date"), "category", "sales", *WIDE_COVARIATES.values()))

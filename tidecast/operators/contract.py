"""Canonical demand contract: coercion, validation report, row-level violations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.scalars import (
    day_or_null,
    nan_to_null,
    number_or_null,
    strip,
    text_or_null,
)
from tidecast.operators.rounds import durable

# The eight contract columns, in contract order.
CONTRACT_COLUMNS = [
    "date", "category", "sales", "avg_temp", "max_temp", "min_temp", "humidity", "rainfall",
]
NUMBER_COLUMNS = CONTRACT_COLUMNS[2:]
SHORT_SERIES_ROWS = 10

DEMAND_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("category", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in NUMBER_COLUMNS]
)


class DemandContractError(ValueError):
    """The demand table breaks the contract."""


def coerce(df: DataFrame) -> DataFrame:
    """Project the contract columns and parse them; what cannot be parsed becomes NULL.

    Row-local: no shuffle. Order is given to the rows only where they are written or previewed.
    """
    absent = [name for name in CONTRACT_COLUMNS if name not in df.columns]
    if absent:
        raise DemandContractError(f"Missing required columns: {', '.join(absent)}")
    is_text = {field.name: isinstance(field.dataType, T.StringType) for field in df.schema}

    def parsed(name: str) -> Column:
        column = F.col(name)
        if name == "date":
            return day_or_null(text_or_null(column)) if is_text[name] else column.cast("date")
        if name == "category":
            return strip(text_or_null(column) if is_text[name] else column.cast("string"))
        if is_text[name]:
            return number_or_null(text_or_null(column))
        return nan_to_null(column.cast("double"))

    return df.select(*[parsed(name).alias(name) for name in CONTRACT_COLUMNS])


def range_rules() -> dict[str, Column]:
    """Message -> predicate that is true on a breaking row (NULLs never break a range)."""
    return {
        "sales values must be non-negative": F.col("sales") < 0,
        "humidity must be between 0 and 100": (F.col("humidity") < 0) | (F.col("humidity") > 100),
        "rainfall must be non-negative": F.col("rainfall") < 0,
    }


def violations(demand: DataFrame) -> DataFrame:
    """Rows that break a row-level rule, with the list of broken rules. Row-local."""
    rules = {
        "invalid date": F.col("date").isNull(),
        "empty category": F.col("category").isNull() | (F.col("category") == ""),
        **{message: F.coalesce(rule, F.lit(False)) for message, rule in range_rules().items()},
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return demand.withColumn("violations", broken).filter(F.size("violations") > 0)


def key_counts(demand: DataFrame) -> DataFrame:
    """Rows per (category, date) and what they lack or break; NULL keys count as equal.

    Everything a report needs is counted here, in one pass over the source with a map-side combine.
    """
    values = [name for name in CONTRACT_COLUMNS if name not in ("category", "date")]
    missing = [F.count_if(F.col(name).isNull()).alias(f"missing_{name}") for name in values]
    broken = [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"broken_{i}") for i, rule in enumerate(range_rules().values())]
    return demand.groupBy("category", "date").agg(F.count(F.lit(1)).alias("rows"), *missing, *broken)


def contract_counts(keys: DataFrame) -> DataFrame:
    """One row of row-level counters out of `key_counts`."""

    def total(value: Column, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast("long")

    rows, category = F.col("rows"), F.col("category")
    of_key = {"category": category.isNull(), "date": F.col("date").isNull()}
    counters = [
        total(rows).alias("rows"), total(rows, of_key["date"]).alias("invalid_dates"),
        total(rows, category.isNull() | (category == "")).alias("empty_categories"),
    ]
    counters += [(total(F.col(f"broken_{i}")) > 0).cast("long").alias(f"broken_{i}") for i in range(len(range_rules()))]
    counters += [
        (total(rows, of_key[name]) if name in of_key else total(F.col(f"missing_{name}"))).alias(f"missing_{name}")
        for name in CONTRACT_COLUMNS
    ]
    return keys.agg(*counters)


def category_rows(keys: DataFrame) -> DataFrame:
    """Rows per category out of `key_counts`; a NULL category is a category of its own."""
    return keys.groupBy("category").agg(F.sum("rows").alias("rows"))


def year_counts(keys: DataFrame) -> DataFrame:
    """Rows, and rows beyond the first of their key, per calendar year out of `key_counts`.

    The group of unknown dates stays in, as its keys can repeat too.
    """
    return keys.groupBy(F.year("date").alias("year")).agg(
        F.sum("rows").alias("rows"), F.sum(F.col("rows") - 1).alias("repeats"))


def validation_report(demand: DataFrame) -> DataFrame:
    """The report as rows (section, item, value) over coerced demand, none of it on the driver.

    Sections: `total`, `missing`, `broken` (0/1 per range rule), `year`, `category`,
    `short_category` and `few_years`.
    """
    # All that follows starts from one shuffle of the keys, which Spark plans once and reuses.
    keys = key_counts(demand)
    counts = contract_counts(keys)
    stacked = [("total", "rows", "rows"), ("total", "invalid_dates", "invalid_dates"),
               ("total", "empty_categories", "empty_categories")]
    stacked += [("broken", message, f"broken_{i}") for i, message in enumerate(range_rules())]
    stacked += [("missing", name, f"missing_{name}") for name in CONTRACT_COLUMNS]
    cells = F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), F.col(column).alias("value"))
        for section, item, column in stacked
    ])
    counted = counts.select(F.inline(cells))
    years = year_counts(keys)
    # `known` is an aggregate, so that no filter on dates reaches below the shared shuffle.
    known = F.when(F.col("year").isNotNull(), F.col("rows"))
    repeats = years.agg(F.coalesce(F.sum("repeats"), F.lit(0)).cast("long").alias("value")).select(
        F.lit("total").alias("section"), F.lit("duplicate_rows").alias("item"), "value")
    dated = years.groupBy("year").agg(F.sum(known).alias("value")).filter(F.col("value").isNotNull())
    year_rows = dated.select(F.lit("year").alias("section"), F.col("year").cast("string").alias("item"), "value")
    few_years = years.agg(F.count(known).alias("value")).filter(F.col("value") < 2).select(
        F.lit("few_years").alias("section"), F.lit("years").alias("item"), "value"
    )
    categories = category_rows(keys)
    category_cells = F.array_compact(F.array(
        F.when(F.col("category").isNotNull(), F.lit("category")),
        F.when(F.col("rows") < SHORT_SERIES_ROWS, F.lit("short_category")),
    ))
    category_list = categories.select(
        F.explode(category_cells).alias("section"), F.col("category").alias("item"),
        F.col("rows").alias("value"),
    )
    return reduce(DataFrame.unionByName, [counted, repeats, year_rows, few_years, category_list])


@dataclass(frozen=True)
class ValidationReport:
    """Counters on the driver (a fixed number); lists that grow with the data stay DataFrames."""

    rows: int
    duplicate_rows: int
    missing_by_column: dict[str, int]
    years: list[int]
    errors: list[str]
    warnings: list[str]
    categories: DataFrame
    short_categories: DataFrame

    def messages(self) -> DataFrame:
        """All warnings in report order: years, short categories by name, then the errors."""
        spark = self.categories.sparkSession
        short = self.short_categories.select(
            F.lit(1).alias("part"), F.col("category").alias("sort_key"),
            F.concat(F.lit("Category "), F.coalesce("category", F.lit("<NA>")),
                     F.lit(f" has fewer than {SHORT_SERIES_ROWS} observations")).alias("message"),
        )
        fixed = [(0, str(i), text) for i, text in enumerate(self.warnings)]
        fixed += [(2, str(i), text) for i, text in enumerate(self.errors)]
        listed = spark.createDataFrame(fixed, "part int, sort_key string, message string")
        return listed.unionByName(short).orderBy("part", F.col("sort_key").asc_nulls_last())


def validate(df: DataFrame, strict: bool = True) -> ValidationReport:
    """Check demand without repairing it; strict mode raises the errors joined by `; `.

    The source is read once: its counts per key are stored, and all figures come from them.
    """
    keys = durable(key_counts(coerce(df)))
    counts = contract_counts(keys).first().asDict()
    # One row per calendar year, so this list is small whatever the table size.
    per_year = year_counts(keys).collect()
    duplicate_rows = sum(row["repeats"] for row in per_year)
    years = sorted(row["year"] for row in per_year if row["year"] is not None)
    errors = []
    if counts["invalid_dates"]:
        errors.append(f"{counts['invalid_dates']} rows have invalid dates")
    if counts["empty_categories"]:
        errors.append(f"{counts['empty_categories']} rows have empty categories")
    if duplicate_rows:
        errors.append(f"{duplicate_rows} duplicate date/category rows")
    errors += [m for i, m in enumerate(range_rules()) if counts[f"broken_{i}"]]
    if strict and errors:
        raise DemandContractError("; ".join(errors))
    warnings = []
    if len(years) < 2:
        warnings.append("Fewer than two calendar years are available for a year-on-year holdout")
    categories = category_rows(keys)
    return ValidationReport(
        rows=counts["rows"],
        duplicate_rows=duplicate_rows,
        missing_by_column={name: counts[f"missing_{name}"] for name in CONTRACT_COLUMNS},
        years=years,
        errors=errors,
        warnings=warnings,
        categories=categories.filter(F.col("category").isNotNull()),
        short_categories=categories.filter(F.col("rows") < SHORT_SERIES_ROWS),
    )

"""Leakage-safe features for all series at once.

Every window is partitioned by `category` first and the table is shuffled by `category` once, so
all features come out of one exchange and one sort. A (category, split) group holds one row per
calendar day of one year: the contract makes (category, date) unique, and `prepare_features`
refuses repeated days, so a group never exceeds 366 rows however large the table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.scalars import clip, scale_col

TRAIN, TEST = "train", "test"


def series():
    return Window.partitionBy("category")


def in_split():
    return Window.partitionBy("category", "split").orderBy("date")


def up_to_now():
    return in_split().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def only_train(column):
    return F.when(F.col("split") == TRAIN, column)


def select_categories(demand: DataFrame, categories: list[str] | str = "all") -> DataFrame:
    """All categories, or the listed ones (an `IN` filter that reaches the scan)."""
    return demand if categories == "all" else demand.filter(F.col("category").isin(list(categories)))


def absent_categories(demand: DataFrame, categories: list[str]) -> DataFrame:
    """Listed categories without a single row."""
    listed = demand.sparkSession.createDataFrame([(name,) for name in categories], "category string")
    found = select_categories(demand, categories).select("category").distinct()
    return listed.join(found, "category", "left_anti")


def split_years(demand: DataFrame, train_year: int, test_year: int) -> DataFrame:
    """Keep the two holdout years as date ranges (pushed to the scan) and tag the split."""

    def inside(year: int):
        return F.col("date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))

    return demand.filter(inside(train_year) | inside(test_year)).withColumn(
        "split", F.when(inside(train_year), TRAIN).otherwise(TEST)
    )


def observe_and_fill(holdout: DataFrame, columns: list[str]) -> DataFrame:
    """Add position, `target_observed`, training medians and filled columns.

    The median is taken on unfilled training values; filling runs forward inside one split only
    and falls back to that median. Raw values are replaced by the filled ones.
    """
    located = holdout.repartition("category").select(
        "category", "split", "date",
        F.row_number().over(in_split()).alias("pos"),
        (F.lag("date").over(in_split()) == F.col("date")).alias("repeated_day"),
        F.col("sales").isNotNull().alias("target_observed"),
        *columns,
        *[F.last(c, ignorenulls=True).over(up_to_now()).alias(f"{c}_forward") for c in columns],
    )
    with_medians = located.select(
        "*",
        *[F.median(only_train(F.col(c))).over(series()).alias(f"{c}_median") for c in columns],
        F.count_if(F.col("split") == TRAIN).over(series()).alias("train_days"),
        F.count_if(F.col("split") == TEST).over(series()).alias("test_days"),
        F.coalesce(F.bool_or("repeated_day").over(series()), F.lit(False)).alias("has_repeats"),
    )
    return with_medians.select(
        "category", "split", "date", "pos", "target_observed",
        *[F.coalesce(f"{c}_forward", f"{c}_median").alias(c) for c in columns],
        *[f"{c}_median" for c in columns],
        "train_days", "test_days", "has_repeats",
    )


def series_problem(columns: list[str], train_year: int, test_year: int):
    """Why a series cannot be used, or NULL."""
    name = F.coalesce("category", F.lit("<NA>"))
    unusable = [
        F.when(F.col(f"{c}_median").isNull(),
               F.concat(name, F.lit(f": training column {c} has no usable values")))
        for c in columns
    ]
    return F.coalesce(
        F.when((F.col("train_days") == 0) | (F.col("test_days") == 0),
               F.concat(name, F.lit(f": both {train_year} and {test_year} data are required"))),
        F.when(F.col("has_repeats"), F.concat(name, F.lit(": duplicate date/category rows"))),
        *unusable,
    )


def prepare_features(
    demand: DataFrame,
    train_year: int,
    test_year: int,
    covariates: list[str],
    on_error: str = "raise",
) -> DataFrame:
    """Filled holdout rows with per-series medians and training scales as columns.

    An unusable series stops the job with its reason (`on_error="raise"`, inside the plan) or is
    left out (`"drop"`; `series_problems` lists them).
    """
    columns = ["sales", *covariates]
    filled = observe_and_fill(split_years(demand, train_year, test_year), columns)
    problem = series_problem(columns, train_year, test_year)
    usable = problem.isNull()
    if on_error == "raise":
        usable = F.when(usable, True).otherwise(F.raise_error(problem).cast("boolean"))
    scales = [
        agg(only_train(F.col(c))).over(series()).alias(f"{c}_{end}")
        for c in columns for end, agg in (("min", F.min), ("max", F.max))
    ]
    return filled.filter(usable).drop("train_days", "test_days", "has_repeats").select("*", *scales)


def series_problems(
    demand: DataFrame, train_year: int, test_year: int, covariates: list[str]
) -> DataFrame:
    """One row (category, reason) per series that `prepare_features` cannot use."""
    columns = ["sales", *covariates]
    train, repeated = F.col("split") == TRAIN, F.col("rows") > 1
    days = (
        split_years(demand, train_year, test_year).groupBy("category", "date")
        .agg(F.first("split").alias("split"), F.count(F.lit(1)).alias("rows"),
             *[F.max(only_train(F.col(c))).alias(c) for c in columns])
    )
    facts = days.groupBy("category").agg(
        F.count_if(train).alias("train_days"), F.count_if(~train).alias("test_days"),
        F.bool_or(repeated).alias("has_repeats"),
        *[F.max(c).alias(f"{c}_median") for c in columns],
    )
    reason = series_problem(columns, train_year, test_year)
    return facts.select("category", reason.alias("reason")).filter(F.col("reason").isNotNull())


def feature_stats(prepared: DataFrame, covariates: list[str]) -> DataFrame:
    """Long statistics: (category, feature, median, minimum, maximum)."""
    columns = ["sales", *covariates]
    parts = [f"{c}_{part}" for c in columns for part in ("median", "min", "max")]
    one_row = prepared.groupBy("category").agg(*[F.max(part).alias(part) for part in parts])
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_median").alias("median"),
                 F.col(f"{c}_min").alias("minimum"), F.col(f"{c}_max").alias("maximum"))
        for c in columns
    ])
    return one_row.select("category", F.inline(cells))


def make_supervised(prepared: DataFrame, lags: list[int], covariates: list[str]) -> DataFrame:
    """Lagged history and target-date covariates on the training scale.

    Lags are row offsets inside a split. Lags and covariates are clipped to [0, 1]; `target_norm`
    is not. Rows without full history or with an unobserved target are dropped after the windows.
    """

    def scaled(column, name: str):
        return scale_col(column, F.col(f"{name}_min"), F.col(f"{name}_max"))

    rows = prepared.select(
        "category", "split", "date", "pos", "target_observed",
        F.col("sales").alias("target"),
        scaled(F.col("sales"), "sales").alias("target_norm"),
        *[clip(scaled(F.lag("sales", k).over(in_split()), "sales")).alias(f"sales_lag_{k}") for k in lags],
        *[clip(scaled(F.col(c), c)).alias(c) for c in covariates],
        "sales_min", "sales_max",
    )
    return rows.filter((F.col("pos") > max(lags)) & F.col("target_observed")).drop("target_observed")


def evaluation_dates(prepared: DataFrame, min_history: int = 7) -> DataFrame:
    """Dates after the first `min_history` rows of the test split, observed or not."""
    return prepared.filter((F.col("split") == TEST) & (F.col("pos") > min_history)).select("category", "date")


def feature_variants(lags: list[int], covariates: list[str]) -> dict[str, list[str]]:
    """Variant name -> ordered feature columns."""
    history = [f"sales_lag_{k}" for k in lags]
    return {"sales_only": history, "target_weather": [*history, *covariates]}

"""Demand tables derived from the test tables (stand-ins for real demand and weather)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.contract import CONTRACT_COLUMNS
from tidecast.operators.features import prepare_features

TRAIN_YEAR, TEST_YEAR = 1996, 1997
LAGS = [1, 2, 3]
COVARIATES = ["avg_temp", "humidity", "rainfall"]
PERIOD = 7
# A prime, so that no mean or price ends on a half at the compared decimal.
PRICE_UNIT = 10007


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_demand(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Daily quantity per brand with covariates per day; sales are unknown on every 13th.

    Sales are summed per (part, day) before the join, so a part with a large share of all lines
    reaches the join as at most one row per day. A range of years is a scan filter.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    if years is not None:
        start = F.lit(f"{years[0]}-01-01").cast("timestamp_ntz")
        end = F.lit(f"{years[1] + 1}-01-01").cast("timestamp_ntz")
        lines = lines.filter((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end))
        orders = orders.filter((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))
    per_part = lines.groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("quantity")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("category"))
    sales = (
        per_part.join(part, per_part.l_partkey == part.p_partkey).groupBy("category", "date")
        .agg(F.sum("quantity").alias("sales"))
    )
    price = F.col("o_totalprice")
    days = orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.avg(price) / PRICE_UNIT).alias("avg_temp"),
        (F.max(price) / PRICE_UNIT).alias("max_temp"),
        (F.min(price) / PRICE_UNIT).alias("min_temp"),
        (F.avg((F.col("o_orderstatus") == "F").cast("double")) * 100).alias("humidity"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("rainfall"),
    )
    known = F.when(F.dayofmonth("date") != 13, F.col("sales"))
    return sales.join(days, "date", "left").withColumn("sales", known).select(*CONTRACT_COLUMNS)


def holdout_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_demand(spark, sf_dir, (TRAIN_YEAR, TEST_YEAR))


def prepared_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_features(holdout_demand(spark, sf_dir), TRAIN_YEAR, TEST_YEAR, COVARIATES)


def raw_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table as text with faults put in by rule: what a delimited file would hold.

    Every 28th of a month is repeated; on the 5th the category has outer blanks and sales read
    `NA`; on the 6th the category is blank; on the 7th sales are negative; on the 8th the date
    cannot be parsed; on the 9th humidity is 101; on the 10th rainfall is negative.
    """
    demand = derived_demand(spark, sf_dir)
    day = F.dayofmonth("date")
    copies = F.explode(F.when(day == 28, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    text = {c: F.col(c).cast("string") for c in CONTRACT_COLUMNS}
    text["date"] = F.when(day == 8, F.concat(F.lit("day "), text["date"])).otherwise(text["date"])
    text["category"] = (
        F.when(day == 5, F.concat(F.lit("  "), F.col("category"), F.lit(" ")))
        .when(day == 6, F.lit("   ")).otherwise(F.col("category"))
    )
    text["sales"] = F.when(day == 5, F.lit("NA")).when(day == 7, F.lit("-1")).otherwise(text["sales"])
    text["humidity"] = F.when(day == 9, F.lit("101")).otherwise(text["humidity"])
    text["rainfall"] = F.when(day == 10, F.lit("-0.5")).otherwise(text["rainfall"])
    repeated = demand.withColumn("copy", copies)
    return repeated.select(*[text[c].alias(c) for c in CONTRACT_COLUMNS], F.lit("x").alias("extra"))


# The headings of the wide stand-in: every year and brand of the tables. One brand has the name that
# the conversion replaces, and 1997 has no Rainfall column.
WIDE_YEARS = list(range(1995, 2002))
WIDE_BRANDS = {f"Brand#{i}": "insecticide control" if i == 2 else f"brand {i}" for i in range(1, 26)}
WIDE_HEADINGS = {"AVG temp": "avg_temp", "MAX temp": "max_temp", "MIN temp": "min_temp",
                 "Humidity": "humidity", "Rainfall": "rainfall"}


def wide_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide stand-in: `Date` as d/M, `<yyyy> <category> sales` and weather columns per year.

    First one row per (day, year) with a column per brand, then one row per day: sums meet map-side
    in both steps.
    """
    demand = derived_demand(spark, sf_dir)
    keys = [F.month("date").alias("m"), F.dayofmonth("date").alias("d"), F.year("date").alias("y")]
    yearly = demand.groupBy(*keys).agg(
        *[F.max(F.when(F.col("category") == brand, F.col("sales"))).alias(name) for brand, name in WIDE_BRANDS.items()],
        *[F.max(c).alias(c) for c in WIDE_HEADINGS.values()],
    )
    year_row = F.struct(*[c for c in yearly.columns if c not in ("m", "d", "y")])
    # One row per (day, year) is left, so the greatest row of a year is its only one.
    days = yearly.groupBy("m", "d").agg(*[
        F.max(F.when(F.col("y") == year, year_row)).alias(f"of_{year}") for year in WIDE_YEARS])
    cells = []
    for year in WIDE_YEARS:
        of_year = F.col(f"of_{year}")
        cells += [of_year[name].alias(f"{year} {name} sales") for name in WIDE_BRANDS.values()]
        cells += [of_year[c].alias(f"{year} {h}") for h, c in WIDE_HEADINGS.items() if (year, c) != (1997, "rainfall")]
    return days.select(F.concat(F.col("d"), F.lit("/"), F.col("m")).alias("Date"), *cells)

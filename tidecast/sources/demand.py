"""Demand readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators.contract import coerce, validate
from tidecast.operators.reshape import wide_to_long
from tidecast.sources.paths import resolve_source


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header as text columns (nothing inferred), or a Parquet table."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    # The header gives the names; every column stays text, so reading needs no inference pass.
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)


def read_demand(spark: SparkSession, path: str, private_root: str | None = None) -> DataFrame:
    """Canonical demand, validated strictly and coerced."""
    raw = read_text_table(spark, resolve_source(spark, path, private_root))
    validate(raw)
    return coerce(raw)


def read_wide(spark: SparkSession, path: str, private_root: str | None = None) -> DataFrame:
    """Legacy wide demand as canonical rows."""
    return wide_to_long(read_text_table(spark, resolve_source(spark, path, private_root)))


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write once, never over an existing table; delimited files get a header and ISO dates."""
    if fmt == "csv":
        dates_as_text(df).write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)
    else:
        df.write.mode("errorifexists").format(fmt).save(path)


def prepare(df: DataFrame, out: str, legacy_wide: bool = True, fmt: str = "csv") -> DataFrame:
    """Convert (wide) or pass on (canonical) a raw table, validate it strictly, write it.

    A canonical input is checked but written as it came, with its extra columns.
    """
    prepared = wide_to_long(df) if legacy_wide else df
    validate(prepared)
    write_table(prepared, out, fmt)
    return prepared

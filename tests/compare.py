"""Run registered queries and their SQL counterparts side by side and compare all rows.

Usage: python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def table_rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(df, connection, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    ours = table_rows(df.columns, df.collect())
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = table_rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}"
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(unequal)} of {len(ours)} rows differ, first {unequal[0]}" if unequal else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    oracles = contract.oracle_sql()
    for name, build in contract.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.perf_counter()
        if name in oracles:
            verdict = compare(build(spark, sf_dir), connection, oracles[name])
        else:
            verdict = f"no SQL, {build(spark, sf_dir).count()} rows"
        print(f"{'ok  ' if verdict is None else 'DIFF' if name in oracles else 'rows'} {name:32s} "
              f"{time.perf_counter() - started:6.2f}s {verdict or ''}", flush=True)


if __name__ == "__main__":
    main()

"""A tree of digests over a table of series: day, series, bucket of series, table.

Two versions of a table are compared from the top: equal digests end the comparison, and below a different
one only its own children are looked at. So it names the series and the days that changed.

A leaf is the SHA-256 of a row's cells, a series that of its leaves in time order, a bucket that of its
members in the order of their paths. A path is the first hexadecimal signs of the hashed key, so a node
has about 16 children on every level but the lowest, and digests of parts made apart can be put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.scalars import fixed_units

LEVELS = 4  # signs of the longest path: 65,536 buckets above the series


def cell(field: T.StructField) -> Column:
    """Text of a value that every engine writes alike: numbers as billionths, texts with their length."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.NumericType):
        number = column.cast("double")
        text = F.coalesce(fixed_units(number).cast("string"), number.cast("string"))
    elif isinstance(field.dataType, T.DateType):
        text = F.date_format(column, "yyyy-MM-dd")
    else:
        plain = column.cast("string")
        text = F.concat(F.length(plain).cast("string"), F.lit(":"), plain)
    return F.coalesce(text, F.lit("null"))


def leaf(schema: T.StructType, columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[cell(schema[c]) for c in columns]), 256)


def joined(entries: Column, digest: str) -> Column:
    """SHA-256 over the digests of sorted entries."""
    return F.sha2(F.array_join(F.transform(F.sort_array(entries), lambda x: x[digest]), ""), 256)


def in_time_order(day: str, digest: Column, when: Column | None = None) -> Column:
    """Aggregate: digest of a series from its leaves, or of those rows where `when` holds. A series is bounded by its days."""
    entry = F.struct(F.col(day).alias("day"), digest.alias("digest"))
    return joined(F.collect_list(entry if when is None else F.when(when, entry)), "digest")


def leaves(table: DataFrame, keys: list[str], day: str, columns: list[str]) -> DataFrame:
    """(keys, day, digest): one row per row of the table."""
    return table.select(*keys, F.col(day).alias("day"), leaf(table.schema, [day, *columns]).alias("digest"))


def series(days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, days, digest): one row per series."""
    return days.groupBy(*keys).agg(F.count("*").alias("days"), in_time_order("day", F.col("digest")).alias("digest"))


def tree(nodes: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """(level, path, nodes, digest): buckets of series from level `levels` up to the table at level 0.

    A table without series has no rows.
    """
    name = F.sha2(F.concat_ws("|", *[F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)) for k in keys]), 256)
    below = nodes.select(name.alias("path"), F.col("digest"), F.lit(1).cast("bigint").alias("nodes"))
    made = None
    for level in range(levels, -1, -1):
        below = below.groupBy(F.substring("path", 1, level).alias("at")).agg(
            F.sum("nodes").alias("nodes"), joined(F.collect_list(F.struct("path", "digest")), "digest").alias("digest"),
        ).select(F.col("at").alias("path"), "digest", "nodes")
        rows = below.select(F.lit(level).alias("level"), "path", "nodes", "digest")
        made = rows if made is None else made.unionByName(rows)
    return made


def changed_days(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, change): days that are `added`, `removed` or `changed` between two tables of leaves.

    Only leaves of series whose own digests differ meet each other; rows that repeat a day count as one leaf.
    """
    def of_series(days, name):
        return series(days, keys).select(*keys, F.col("digest").alias(name))

    both = of_series(old, "before").join(of_series(new, "after"), keys, "full_outer")
    moved = both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*keys)

    def of_days(days, name):
        own = days.join(moved, keys, "left_semi")
        return own.groupBy(*keys, "day").agg(joined(F.collect_list(F.struct("digest")), "digest").alias(name))

    met = of_days(old, "before").join(of_days(new, "after"), [*keys, "day"], "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return met.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, "day", kind.alias("change"))

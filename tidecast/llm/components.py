"""Connected components of a large graph, as rounds of joins over shrinking star graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import mapped, stored


def locally_joined(edges: DataFrame) -> DataFrame:
    """Each task replaces its own edges by stars around the smallest node; what is connected stays so."""

    def run(batches):
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def stars():
            nodes = np.array([x for x in parent if parent[x] != x], np.int64)
            roots = np.array([top(x) for x in nodes.tolist()], np.int64)
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if parent:
            yield stars()

    return edges.transform(mapped, run, "u bigint, v bigint")


def rooted_at(stars: DataFrame) -> DataFrame:
    """(node, root): the edges of finished stars, and their centres."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def components(edges: DataFrame, task_edges: int = 250_000, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node that can be reached. Empty edges give no rows."""
    x, y = edges.columns
    found = some_components(edges, task_edges, most_rounds)
    if found is None:
        return edges.select(F.col(x).cast("long").alias("node"), F.col(y).cast("long").alias("root")).limit(0)
    return found


def some_components(edges: DataFrame, task_edges: int = 250_000, most_rounds: int = 60) -> DataFrame | None:
    """The same, and None for empty edges, so that nothing more is planned for them.

    Tasks of at most `task_edges` edges first join what they see; if one task saw all, that is the answer.
    What reaches across tasks then alternates two steps until nothing changes: every node links its larger
    neighbours to the smallest node it sees, and every node links its smaller neighbours to the smallest of
    them. Both only take a minimum per node and join it back, so a hub's edges are never gathered.
    """
    x, y = edges.columns
    plain = stored(edges.select(F.col(x).cast("long").alias("u"), F.col(y).cast("long").alias("v")))
    count = plain.count()
    if not count:
        return None
    parts = 1 + count // task_edges
    stars, before = stored(locally_joined(plain.repartition(parts)).distinct()), None
    if parts == 1:
        return rooted_at(stars)
    for _ in range(most_rounds):
        seen = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen.n == 0 or (seen.n, seen.s) == before:
            return rooted_at(stars)
        before = (seen.n, seen.s)
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        stars = stored(small)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

"""Exact top-k by a Voronoi join for the largest inner product.

Pivots cut the space into cells. Every cell is summarised by its radius and by the range of each component;
queries are grouped by their nearest pivot. A bounded set of data rows gives every query a score that its
k-th best answer reaches at least. A cell is sent to a block of queries only if, by its summary, it can hold
a score of that height for one of them; the pairs are solved locally.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.cells import answers, best, classes, matrix, met, packed_queries, scored, usable
from tidecast.llm.common import by_batch, lists, mapped, stored


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """floor(scale * x) of every component, as whole doubles."""
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))


def hashed_sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most `most` distinct vectors, those with the smallest hashes; the driver holds no more than these."""
    chosen = rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(most).toArrow()
    return matrix(chosen.column("vector")) if chosen.num_rows else np.zeros((0, 0))


def nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gaps = (pivots * pivots).sum(axis=1)[None, :] - 2.0 * points @ pivots.T
    return gaps.argmin(axis=1)


def placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, vector, ids): rows with the number of their nearest pivot."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = nearest(matrix(batch.column(0)), pivots).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cells), *batch.columns], ["cell", "vector", "ids"])

    return rows.select("vector", "ids").transform(mapped, by_batch(run), "cell bigint, vector array<double>, ids array<bigint>")


def summaries(cells: DataFrame, pivots: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per cell its radius and the range of each component; as many rows as there are pivots reach the driver."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            points = matrix(batch.column(1))
            numbers = batch.column(0).to_numpy()
            away = np.sqrt(((points - pivots[numbers]) ** 2).sum(axis=1))
            for cell in np.unique(numbers).tolist():
                own = numbers == cell
                made = [float(away[own].max()), points[own].min(axis=0), points[own].max(axis=0)]
                old = found.get(cell)
                found[cell] = made if old is None else [
                    max(old[0], made[0]), np.minimum(old[1], made[1]), np.maximum(old[2], made[2])
                ]
        if found:
            low, high = (np.concatenate([v[i] for v in found.values()]) for i in (1, 2))
            size = np.full(len(found), len(low) // len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array([v[0] for v in found.values()]), lists(low, size), lists(high, size)],
                ["cell", "radius", "low", "high"],
            )

    parts = cells.select("cell", "vector").transform(mapped, run, "cell bigint, radius double, low array<double>, high array<double>")
    each = parts.select("cell", "radius", F.posexplode(F.arrays_zip("low", "high")).alias("i", "range"))
    least = each.groupBy("cell", "i").agg(F.min("range.low").alias("low"), F.max("range.high").alias("high"), F.max("radius").alias("radius"))
    whole = least.groupBy("cell").agg(F.max("radius").alias("radius"), F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("r"))
    return {
        row.cell: (row.radius, np.array([x.low for x in row.r]), np.array([x.high for x in row.r]))
        for row in whole.collect()
    }


def search(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64, k: int = 20,
    every: int = 20, most_pivots: int = 256, most_sample: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): exact answers for rows whose id is divisible by `every`.

    Scores are inner products of floor(scale * x), ties go to the smaller id, a row is no answer to itself,
    and fewer than `k` candidates are all returned. Null vectors, null or non-finite components, empty
    vectors and null ids take no part. Rows that repeat an id are further candidates under that id, except
    for the query of the same id. Vectors are of one length. Other columns are ignored; an empty table
    gives no rows. Pivots and the sample that gives the first bound are bounded; they decide how much is
    compared, never what is found.
    """
    rows = integers(usable(table, id_column, vector), scale).distinct()
    data = stored(classes(rows, k))
    asked = stored(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector", F.xxhash64("vector").alias("number")))
    sample = hashed_sample(data, most_sample)
    if not len(sample):
        empty = "query_id bigint, rank int, vec_id bigint, score bigint"
        return table.sparkSession.createDataFrame([], empty)
    pivots = sample[: min(most_pivots, max(1, len(sample) // 64))]
    cells = stored(placed(data, pivots))
    known = summaries(cells, pivots)
    numbers = np.array(sorted(known), np.int64)
    radius = np.array([known[c][0] for c in numbers.tolist()])
    low, high = (np.stack([known[c][i] for c in numbers.tolist()]) for i in (1, 2))
    centres = pivots[numbers]

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Group of each query, and a score that at least `k + 1` distinct vectors reach."""
        points = matrix(batch.column(1))
        first = np.partition(points @ sample.T, max(0, len(sample) - k - 1), axis=1)
        floor = first[:, len(sample) - k - 1] if len(sample) > k else np.full(len(points), -np.inf)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(nearest(points, pivots).astype(np.int64)), pa.array(floor)],
            ["number", "vector", "group", "floor"],
        )

    def visits(batches):
        for batch in batches:
            for block, _, queries, floors in zip(*(batch.column(i) for i in range(4))):
                points, least = matrix(queries.values), floors.values.to_numpy()
                ball = points @ centres.T + np.sqrt((points * points).sum(axis=1))[:, None] * radius[None, :]
                box = np.maximum(points, 0) @ high.T + np.minimum(points, 0) @ low.T
                reach = np.minimum(ball, box) * (1 + 1e-9) + 1e-6
                needed = numbers[(reach >= least[:, None]).any(axis=0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(needed), block.as_py())), pa.array(needed)], ["block", "cell"]
                )

    distinct = asked.select("number", "vector").dropDuplicates(["number"])
    floored = distinct.transform(mapped, by_batch(grouped), "number bigint, vector array<double>, group bigint, floor double")
    blocks = stored(packed_queries(floored))
    wanted = blocks.select("block", "numbers", "vectors", "floors").transform(mapped, visits, "block bigint, cell bigint")
    found = scored(met(wanted, blocks, cells), k, lambda a, b: (a * b).sum(axis=1))
    return answers(best(found, k), asked.select("query_id", "number"), k).withColumn("score", F.col("score").cast("long"))

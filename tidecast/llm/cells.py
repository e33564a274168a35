"""Vector search by cells: what the tree search and the Voronoi join have in common.

Equal vectors are one class; of its ids only the smallest `k + 1` can appear in any answer, since a query
that prefers the class takes its ids in order and skips at most its own. Classes lie in cells, cells are
packed into blocks of bounded size, queries into blocks of bounded size; a visit pairs a block of queries
with a cell. A pair of blocks is one matrix product in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import mapped

DATA_BLOCK, QUERY_BLOCK = 1024, 256


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id bigint, vector array<double>) of rows with an id and a finite vector; the rest takes no part."""
    doubles = F.col(vector).cast("array<double>")
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col(id_column).cast("long").alias("id"), doubles.alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & good
    )


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): distinct vectors with their `k + 1` smallest ids; a task keeps so many before the shuffle."""
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def packed_data(placed: DataFrame, block: int = DATA_BLOCK) -> DataFrame:
    """(cell, vectors binary, ids array<array<bigint>>): rows (cell, vector, ids) in blocks of about `block`.

    A cell of any size becomes many blocks, dealt by hash, so no cell is gathered.
    """
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    parts = F.pmod(F.xxhash64("vector"), F.ceil(F.col("n") / block)).alias("part")
    keyed = placed.join(sizes, "cell").select("cell", parts, F.struct("ids", "vector").alias("row"))
    return keyed.groupBy("cell", "part").agg(F.collect_list("row").alias("rows")).select(
        "cell", F.col("rows.vector").alias("vectors"), F.col("rows.ids").alias("ids")
    )


def packed_queries(asked: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """(group, block, numbers, vectors, ...): queries (number, group, vector, floor) in blocks within a group."""
    sizes = asked.groupBy("group").agg(F.count("*").alias("n"))
    parts = F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / block)).alias("part")
    keyed = asked.join(sizes, "group").select("group", parts, F.struct("number", "vector", "floor").alias("row"))
    return keyed.groupBy("group", "part").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        F.xxhash64("group", "part").alias("block"), "group", F.col("rows.number").alias("numbers"),
        F.col("rows.vector").alias("vectors"), F.col("rows.floor").alias("floors"),
    )


def met(visits: DataFrame, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """(numbers, queries, vectors, ids) of every visit: queries travel to the cells that they visit.

    Data is dealt by cell once; what a join task pairs goes straight to its own products.
    """
    sent = visits.join(blocks.select("block", "numbers", F.col("vectors").alias("queries")), "block")
    return sent.join(packed_data(cells), "cell").select("numbers", "queries", "vectors", "ids")


def scored(pairs: DataFrame, k: int, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(number, score, id): the best `k + 1` ids of every pair (numbers, queries, vectors, ids) of blocks.

    The product picks classes, with a margin for its rounding; `exact` scores what is picked.
    """

    def run(batches):
        for batch in batches:
            for numbers, queries, vectors, ids in zip(*(batch.column(i) for i in range(4))):
                numbers = numbers.values.to_numpy()
                asked, data = matrix(queries.values), matrix(vectors.values)
                first = ids.values
                rough = asked @ data.T
                take = min(k + 1, data.shape[0])
                edge = np.partition(rough, data.shape[0] - take, axis=1)[:, data.shape[0] - take]
                slack = 1e-9 * (1.0 + np.abs(edge))
                q, d = np.nonzero(rough >= (edge - slack)[:, None])
                score = exact(asked[q], data[d])
                offsets, flat = first.offsets.to_numpy(), first.values.to_numpy()
                counts = np.diff(offsets)[d]
                ends = np.cumsum(counts)
                at = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(offsets[:-1][d] , counts)
                row, value, name = np.repeat(q, counts), np.repeat(score, counts), flat[at]
                order = np.lexsort((name, -value, row))
                row, value, name = row[order], value[order], name[order]
                place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
                kept = place <= k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[row[kept]]), pa.array(value[kept]), pa.array(name[kept])], ["number", "score", "id"]
                )

    return pairs.transform(mapped, run, "number bigint, score double, id bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    """The best `k + 1` rows per query class, then per query row the best `k` that are not the row itself."""
    order = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    return found.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= k + 1)


def answers(top: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (number, score, id) and the query rows (query_id, number)."""
    listed = top.groupBy("number").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("found"))
    own = asked.join(listed, "number").select(
        "query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("i", "x")
    )
    return own.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.down")).alias("score"))

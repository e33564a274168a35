"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is put into the leaf of its nearest centres, level by
level. A query walks the tree best bin first: a priority queue holds nodes by the best inner product that
their centre and radius promise, the best is opened, and leaves come out in the order of their promise. How
many leaves a query visits is widened until, on a calibration set of queries whose true neighbours are
known from all rows, enough of these lie in the visited leaves.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.cells import answers, best, classes, matrix, met, packed_queries, scored, usable
from tidecast.llm.common import by_batch, mapped, stored
from tidecast.llm.knnjoin import hashed_sample


class Tree:
    """Centres, radii and children by node; node 0 is the root, leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, branches: int, leaf_rows: int, rounds: int = 8, seed: int = 3):
        self.branches, self.rounds, self.rng = branches, rounds, np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [sample.mean(axis=0)], [None], [None]
        self.leaves = 0
        waiting = [(0, sample)]
        while waiting:
            node, rows = waiting.pop(0)
            centres, owner = self._split(rows) if len(rows) > leaf_rows else (None, None)
            if centres is None or len(centres) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            self.children[node] = list(range(len(self.centres), len(self.centres) + len(centres)))
            for i, centre in enumerate(centres):
                self.centres.append(centre)
                self.children.append(None)
                self.leaf.append(None)
                waiting.append((self.children[node][i], rows[owner == i]))
        self.spread = np.zeros(len(self.centres))
        self.centres = np.array(self.centres)
        self.parents = np.zeros(len(self.centres), np.int64)
        for node, below in enumerate(self.children):
            for child in below or ():
                self.parents[child] = node
        self.nodes = np.zeros(self.leaves, np.int64)
        for node, leaf in enumerate(self.leaf):
            if leaf is not None:
                self.nodes[leaf] = node
        own = self.assign(sample)
        away = np.zeros(len(self.centres))
        count = np.zeros(len(self.centres))
        at = self.nodes[own]
        while len(at):  # mean distance of the sample below every node
            np.add.at(away, at, np.sqrt(((sample - self.centres[at]) ** 2).sum(axis=1)))
            np.add.at(count, at, 1)
            up = at > 0
            sample, at = sample[up], self.parents[at[up]]
        self.spread = away / np.maximum(count, 1)

    def _split(self, rows: np.ndarray):
        centres = rows[self.rng.choice(len(rows), min(self.branches, len(rows)), replace=False)]
        for _ in range(self.rounds):
            owner = self._closest(rows, centres)
            filled = np.unique(owner)
            centres = np.stack([rows[owner == i].mean(axis=0) for i in filled])
        return centres, self._closest(rows, centres)

    @staticmethod
    def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(axis=1)[None, :] - 2.0 * rows @ centres.T).argmin(axis=1)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        node = np.zeros(len(rows), np.int64)
        moving = np.arange(len(rows))
        while len(moving):
            for at in np.unique(node[moving]).tolist():
                below = self.children[at]
                own = moving[node[moving] == at]
                if below:
                    node[own] = np.array(below)[self._closest(rows[own], self.centres[below])]
            moving = moving[[self.children[n] is not None for n in node[moving].tolist()]]
        return np.array([self.leaf[n] for n in node.tolist()], np.int64)

    def walk(self, query: np.ndarray, visits: int) -> list[int]:
        """The first `visits` leaves, best bin first."""
        promise = self.centres @ query + np.sqrt(query @ query) * self.spread
        queue, found = [(-promise[0], 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.children[node] is None:
                found.append(self.leaf[node])
            else:
                for child in self.children[node]:
                    heapq.heappush(queue, (-promise[child], child))
        return found


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def calibrated(tree: Tree, cells: DataFrame, asked: DataFrame, k: int, recall: float, most: int) -> int:
    """The fewest visits at which the calibration queries find the share `recall` of their true neighbours.

    At most `most` queries with the smallest hashes are compared with all rows, block by block.
    """
    chosen = asked.select("number", "vector").dropDuplicates(["number"]).orderBy(F.xxhash64(F.lit(5), "number"), "number").limit(most)
    held = chosen.toArrow()
    if not held.num_rows:
        return 1
    numbers, queries = held.column("number").to_numpy(), matrix(held.column("vector"))

    def compare(batches):
        for batch in batches:
            data, cell = matrix(batch.column(1)), batch.column(0).to_numpy()
            rough = queries @ data.T
            take = min(k, data.shape[0])
            at = np.argpartition(-rough, take - 1, axis=1)[:, :take]
            row = np.repeat(np.arange(len(queries)), take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[row]), pa.array(rough[row, at.ravel()]), pa.array(cell[at.ravel()])], ["number", "score", "id"]
            )

    near = best(cells.select("cell", "vector").transform(mapped, compare, "number bigint, score double, id bigint"), k - 1)
    true = near.groupBy("number").agg(F.collect_list("id").alias("leaves")).toArrow().to_pydict()
    place = {n: i for i, n in enumerate(numbers.tolist())}
    needed = []
    for number, leaves in zip(true["number"], true["leaves"]):
        order = {leaf: i + 1 for i, leaf in enumerate(tree.walk(queries[place[number]], tree.leaves))}
        needed += [order[leaf] for leaf in leaves]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def search(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20,
    recall: float = 0.96, branches: int = 10, leaf_rows: int = 128, most_sample: int = 8192, most_calibration: int = 200,
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the best `k` rows by inner product for ids divisible by `every`.

    Scores are exact on the original vectors, in double precision; ties go to the smaller id, a row is no
    answer to itself. Null and zero vectors, null or non-finite components, empty vectors and null ids take
    no part. Rows that repeat an id are further candidates under it. Vectors are of one length; other
    columns are ignored; an empty table gives no rows. The tree is fitted on at most `most_sample` distinct
    vectors, all rows are indexed, and `recall` is reached on `most_calibration` queries against all rows.
    """
    rows = usable(table, id_column, vector).where(F.exists("vector", lambda x: x != 0)).distinct()
    data = stored(classes(rows, k))
    asked = stored(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector", F.xxhash64("vector").alias("number")))
    sample = hashed_sample(data, most_sample)
    if not len(sample):
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tree = Tree(sample, branches, leaf_rows)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(tree.assign(matrix(batch.column(0)))), *batch.columns], ["cell", "vector", "ids"]
        )

    cells = stored(data.transform(mapped, by_batch(place), "cell bigint, vector array<double>, ids array<bigint>"))
    visits = calibrated(tree, cells, asked, k, recall, most_calibration)

    def group(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = matrix(batch.column(1))
        zero = pa.array(np.zeros(len(points)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.assign(points)), zero], ["number", "vector", "group", "floor"])

    distinct = asked.select("number", "vector").dropDuplicates(["number"])
    grouped = distinct.transform(mapped, by_batch(group), "number bigint, vector array<double>, group bigint, floor double")
    blocks = stored(packed_queries(grouped))

    def wanted(batches):
        for batch in batches:
            for block, queries in zip(*(batch.column(i) for i in range(2))):
                leaves = np.array(sorted({leaf for q in matrix(queries.values) for leaf in tree.walk(q, visits)}), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaves), block.as_py())), pa.array(leaves)], ["block", "cell"])

    visited = blocks.select("block", "vectors").transform(mapped, wanted, "block bigint, cell bigint")
    found = scored(met(visited, blocks, cells), k, product)
    return answers(best(found, k), asked.select("query_id", "number"), k)

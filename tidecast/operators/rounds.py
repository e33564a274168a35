"""Training in rounds: every round is one Spark job over all series and seeds at once.

Training rows are packed into chunks of bounded length and never gathered per series: a chunk is
scored against its series' candidates, the partial sums meet in an aggregation, and one state row
per (series, variant, seed) moves to the next round. A long series is many chunks on many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_ROWS = 512
TASK_PAIRS = 32


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by `spark.checkpoint.dir`; a session without one gets one in its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def task_count(spark: SparkSession, pairs: int | None = None) -> int:
    """Tasks for CPU-heavy stages, whose few bytes adaptive execution would put into one task.

    `pairs` is the number of (chunk, job) rows if it is known: a task gets at most `TASK_PAIRS` of
    them, which also bounds the arrays in one Arrow batch.
    """
    cores = spark.sparkContext.defaultParallelism
    if pairs is None:
        return max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, -(-pairs // TASK_PAIRS))


def pack_rows(rows: DataFrame, keys: list[str], features: list[str], position: Column) -> DataFrame:
    """Chunks (keys, chunk, dates, x, y, positions): x is row-major, rows are in date order.

    A chunk holds at most `CHUNK_ROWS` rows, because `position` numbers the rows of a key.
    """
    cell = F.struct(
        "date", F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.col("target_norm").alias("y"), position.alias("position"),
    )
    chunk = F.floor((position - 1) / CHUNK_ROWS).cast("int")
    packed = rows.groupBy(*keys, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return packed.select(
        *keys, "chunk", F.col("cells.date").alias("dates"), F.flatten("cells.x").alias("x"),
        F.col("cells.y").alias("y"), F.col("cells.position").alias("positions"),
    )


def sum_arrays(arrays: Column) -> Column:
    """Element-wise sum of equally long arrays."""
    return F.aggregate(
        F.slice(arrays, 2, F.size(arrays)), F.get(arrays, F.lit(0)),
        lambda total, part: F.zip_with(total, part, lambda a, b: a + b),
    )


def run_rounds(
    state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, tasks: int
) -> DataFrame:
    """Apply `step` up to `rounds` times, until every state row says `done`."""
    state = durable(state)
    for _ in range(rounds):
        waiting = state.filter(~F.col("done"))
        if waiting.isEmpty():
            break
        # The union must not add a partition per round.
        state = durable(step(waiting).unionByName(state.filter("done")).coalesce(tasks))
    return state

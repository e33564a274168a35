"""Neural sequence baseline: one LSTM layer and a linear head over the lags, oldest first.

Training is synchronous full-batch gradient descent in Spark rounds: every chunk of rows yields its
gradient sum at the current parameters, the sums meet in an aggregation, and the Adam step is a
column expression on one state row per (category, seed).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.draws import uniform
from tidecast.functions.scalars import unscale_col
from tidecast.operators.features import TEST, TRAIN
from tidecast.operators.forecasts import tagged
from tidecast.operators.rounds import durable, pack_rows, run_rounds, sum_arrays, task_count

UNITS = 32
# Gate weights (input, recurrent, two biases) and head (weights, bias), one after the other.
BLOCKS = [4 * UNITS, 4 * UNITS * UNITS, 4 * UNITS, 4 * UNITS, UNITS, 1]
PARAMETERS = sum(BLOCKS)
SEED_KEYS = ["category", "seed"]
RATE, DECAY_1, DECAY_2, TINY = 1e-3, 0.9, 0.999, 1e-8


def lstm_pass(parameters, x, slope=None):
    """Outputs for rows of `x` (oldest lag first); with `slope`, a function of the outputs that
    gives the loss derivative, also the parameter gradient by back-propagation through time."""
    w_in, w_rec, b_1, b_2, w_out, b_out = np.split(np.asarray(parameters, dtype=float), np.cumsum(BLOCKS)[:-1])
    w_rec = w_rec.reshape(4 * UNITS, UNITS)
    hidden = cell = np.zeros((len(x), UNITS))
    trace = []
    for t in range(x.shape[1]):
        gates = x[:, t : t + 1] * w_in + hidden @ w_rec.T + b_1 + b_2
        i, f, o = (1 / (1 + np.exp(-gates[:, k * UNITS : (k + 1) * UNITS])) for k in (0, 1, 3))
        g = np.tanh(gates[:, 2 * UNITS : 3 * UNITS])
        before, cell = cell, f * cell + i * g
        trace.append((hidden, before, i, f, g, o, np.tanh(cell)))
        hidden = o * trace[-1][-1]
    output = hidden @ w_out + b_out[0]
    if slope is None:
        return output
    d_out = slope(output)
    d_hidden, d_cell = np.outer(d_out, w_out), np.zeros_like(cell)
    d_in, d_rec, d_bias = np.zeros_like(w_in), np.zeros_like(w_rec), np.zeros_like(b_1)
    for t in reversed(range(x.shape[1])):
        previous, before, i, f, g, o, squashed = trace[t]
        d_cell = d_cell + d_hidden * o * (1 - squashed**2)
        d_gates = np.hstack([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f),
                             d_cell * i * (1 - g**2), d_hidden * squashed * o * (1 - o)])
        d_in, d_rec, d_bias = d_in + d_gates.T @ x[:, t], d_rec + d_gates.T @ previous, d_bias + d_gates.sum(axis=0)
        d_hidden, d_cell = d_gates @ w_rec, d_cell * f
    return output, np.concatenate([d_in, d_rec.ravel(), d_bias, d_bias, hidden.T @ d_out, [d_out.sum()]])


def chunk_gradient(x: Column, y: Column, positions: Column, split: Column, parameters: Column) -> Column:
    """array<double>: gradient sum over the chunk's training rows, then its validation error sum.

    Rows up to position `split` train, later rows validate.
    """

    def batches(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in parts:
            sums = []
            for flat, target, place, last, theta in zip(*batch, strict=True):
                rows, target = np.asarray(flat).reshape(len(target), -1), np.asarray(target)
                train = np.asarray(place) <= last
                wanted = target[train]
                _, gradient = lstm_pass(theta, rows[train], lambda out: 2 * (out - wanted))  # noqa: B023
                missed = lstm_pass(theta, rows[~train]) - target[~train]
                sums.append(np.append(gradient, np.sum(missed**2)))
            yield pd.Series(sums)

    batches.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "array<double>")(x, y, positions, split, parameters)


def chunk_outputs(x: Column, y: Column, parameters: Column) -> Column:
    def batches(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in parts:
            yield pd.Series([
                lstm_pass(theta, np.asarray(flat).reshape(len(target), -1))
                for flat, target, theta in zip(*batch, strict=True)
            ])

    batches.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "array<double>")(x, y, parameters)


def numbered(supervised: DataFrame, split: str) -> DataFrame:
    """Rows of a split with their place among the usable rows of the series (a year of days at most)."""
    by_date = Window.partitionBy("category", "split").orderBy("date")
    return supervised.filter(F.col("split") == split).withColumn("place", F.row_number().over(by_date))


def first_state(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """One row per (category, seed): parameters drawn from +-1/sqrt(units), zero moments."""
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    split = F.greatest(F.lit(1), F.least(F.floor(F.col("rows") * 0.8), F.col("rows") - 1)).cast("int")
    seeded = counts.select("category", "rows", split.alias("split")).withColumn(
        "seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    bound = 1 / math.sqrt(UNITS)
    places = F.sequence(F.lit(0), F.lit(PARAMETERS - 1))
    drawn = F.transform(places, lambda i: (uniform(F.col("seed"), "lstm", i) * 2 - 1) * bound)
    zeros = F.array_repeat(F.lit(0.0), PARAMETERS)
    return seeded.select(
        *SEED_KEYS, "rows", "split", drawn.alias("theta"), zeros.alias("m"), zeros.alias("v"),
        F.lit(None).cast("array<double>").alias("best"), F.lit(None).cast("double").alias("best_loss"),
        F.lit(0).alias("stale"), F.lit(0).alias("epochs"), F.lit(False).alias("done"),
    )


def epoch_step(chunks: DataFrame, max_epochs: int, patience: int, tasks: int):
    """One round: validate the current parameters, keep them if they are the best, take an Adam step."""
    epoch = F.col("epochs")
    gradient = chunk_gradient(F.col("x"), F.col("y"), F.col("positions"), F.col("split"), F.col("theta"))
    loss = F.get("sums", F.lit(PARAMETERS)) / (F.col("rows") - F.col("split"))
    better = F.col("best_loss").isNull() | (F.col("loss") < F.col("best_loss") - 1e-8)
    improved = (epoch > 0) & better
    stale = F.when(epoch == 0, 0).when(better, 0).otherwise(F.col("stale") + 1)
    step_no = epoch + 1
    judged = [
        *SEED_KEYS, "rows", "split", "theta", "m", "v", "sums",
        F.when(improved, F.col("theta")).otherwise(F.col("best")).alias("best"),
        F.when(improved, F.col("loss")).otherwise(F.col("best_loss")).alias("best_loss"),
        stale.alias("stale"), "epochs", ((stale >= patience) | (epoch >= max_epochs)).alias("done"),
    ]
    mean = F.transform(F.slice("sums", 1, PARAMETERS), lambda g: g / F.col("split"))
    m = F.zip_with("m", "g", lambda a, g: a * DECAY_1 + g * (1 - DECAY_1))
    v = F.zip_with("v", "g", lambda a, g: a * DECAY_2 + g * g * (1 - DECAY_2))
    scale_1, scale_2 = 1 - F.pow(F.lit(DECAY_1), step_no), 1 - F.pow(F.lit(DECAY_2), step_no)
    move = F.zip_with("m", "v", lambda a, b: a / F.col("scale_1") / (F.sqrt(b / F.col("scale_2")) + TINY) * RATE)
    theta = F.zip_with("theta", move, lambda p, d: p - d)

    def step(state: DataFrame) -> DataFrame:
        paired = state.select(*SEED_KEYS, "split", "theta").join(chunks, "category")
        spread = paired.repartition(tasks, *SEED_KEYS, "chunk")
        # A group is the chunks of one series: one per 512 days.
        parts = spread.select(*SEED_KEYS, "chunk", gradient.alias("part")).groupBy(*SEED_KEYS).agg(
            F.sort_array(F.collect_list(F.struct("chunk", "part")))["part"].alias("parts"))
        sums = parts.select(*SEED_KEYS, sum_arrays(F.col("parts")).alias("sums"))
        scored = state.join(sums, SEED_KEYS).withColumn("loss", loss).select(*judged)
        moved = scored.withColumn("g", mean).withColumns({"m": m, "v": v, "scale_1": scale_1, "scale_2": scale_2})
        following = F.when(F.col("done"), F.col("theta")).otherwise(theta)
        return moved.withColumn("theta", following).withColumn(
            "epochs", F.when(F.col("done"), epoch).otherwise(step_no)
        ).select(*state.columns)

    return step


def train_lstm(supervised: DataFrame, lags: list[int], seeds: list[int], profile: str = "full") -> DataFrame:
    """Best parameters per (category, seed), with epochs and validation loss."""
    max_epochs, patience = (5, 2) if profile == "smoke" else (300, 30)
    features = [f"sales_lag_{k}" for k in reversed(lags)]
    rows = durable(numbered(supervised, TRAIN).select("category", "date", "place", "target_norm", *features))
    chunks = durable(pack_rows(rows, ["category"], features, F.col("place")))
    tasks = task_count(chunks.sparkSession, chunks.count() * len(seeds))
    step = epoch_step(chunks, max_epochs, patience, tasks)
    return run_rounds(first_state(rows, seeds), step, max_epochs + 1, tasks)


def lstm_details() -> Column:
    return F.create_map(
        F.lit("hidden_units"), F.lit(str(UNITS)), F.lit("epochs"), F.col("epochs").cast("string"),
        F.lit("validation_loss"), F.col("best_loss").cast("string"),
    )


def lstm_forecast(supervised: DataFrame, models: DataFrame, lags: list[int]) -> DataFrame:
    """Test forecasts of trained models on both scales, not clipped."""
    features = [f"sales_lag_{k}" for k in reversed(lags)]
    test = numbered(supervised, TEST)
    chunks = pack_rows(test, ["category"], features, F.col("place"))
    paired = models.select(*SEED_KEYS, F.coalesce("best", "theta").alias("theta")).join(chunks, "category")
    spread = paired.repartition(task_count(supervised.sparkSession), *SEED_KEYS, "chunk")
    outputs = chunk_outputs(F.col("x"), F.col("y"), F.col("theta"))
    rows = spread.select(*SEED_KEYS, "dates", outputs.alias("outputs")).select(
        *SEED_KEYS, F.inline(F.arrays_zip("dates", "outputs")))
    scales = supervised.groupBy("category").agg(F.max("sales_min").alias("sales_min"), F.max("sales_max").alias("sales_max"))
    scaled = rows.join(scales, "category").withColumns({
        "date": F.col("dates"), "predicted_norm": F.col("outputs"),
        "predicted": unscale_col(F.col("outputs"), F.col("sales_min"), F.col("sales_max")),
    })
    return tagged(scaled, "lstm", seed=F.col("seed"))

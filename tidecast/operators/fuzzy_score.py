"""Candidate scoring: mean absolute error of many fuzzy models on the same training rows.

A candidate is one array: centers, sigmas, lower scales and lower lags (feature x mf each), then
a weight and a consequent per candidate rule. Rule g uses the membership given by the digits of g
in base mfs; a weight of 0 switches the rule off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalars import exact_sum
from tidecast.operators.fuzzy_trie import Trie, crisp, ends
from tidecast.operators.rounds import task_count

JOB_KEYS = ["category", "variant", "seed"]


def chunk_errors(x, y, used, mfs, fallback, candidates) -> list[float]:
    """Sum of |prediction - y| on one chunk for each candidate (rows of a matrix)."""
    features = len(used)
    width, rules = features * mfs, mfs**features
    values = x.reshape(len(y), -1)[:, used]
    grid = Trie(np.array(np.unravel_index(np.arange(rules), (mfs,) * features)).T, mfs)
    errors, known = [], None
    for row in candidates:
        shape = row[: 4 * width].reshape(4, features, mfs)
        if known is None or not np.array_equal(known, shape):
            known, (center, sigma, scale, lag) = shape, shape
            gap = values[:, :, None] - center
            high = np.exp(-0.5 * (gap / sigma) ** 2)
            low = np.minimum(high, scale * np.exp(-0.5 * ((gap - lag) / sigma) ** 2))
            low, high = (grid.products(m.reshape(len(y), -1)) for m in (low, high))
        weight, consequent = row[4 * width : 4 * width + rules], row[4 * width + rules :]
        order = np.argsort(consequent, kind="stable")
        order = order[weight[order] > 0]
        lower, gain = low[:, order] * weight[order], (high - low)[:, order] * weight[order]
        level = consequent[order]
        output, _ = crisp(*ends(lower, lower + gain, level), (lower + gain).sum(axis=1), fallback)
        errors.append(float(np.abs(output - y).sum()))
    return errors


def error_sums(x: Column, y: Column, used: Column, mfs: int, fallback: Column,
               base: Column, coords: Column, values: Column) -> Column:
    """array<double>: the error sum of each candidate on a chunk.

    `base` holds one or more whole candidates. `coords` and `values` name further candidates, each
    the first one with a single element changed; so a search need not ship whole copies.
    """

    def batches(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in parts:
            sums = []
            for xs, ys, cols, fall, whole, where, new in zip(*batch, strict=True):
                size = 4 * len(cols) * mfs + 2 * mfs ** len(cols)
                candidates = np.asarray(whole, dtype=float).reshape(-1, size)
                if len(where):
                    changed = np.repeat(candidates[:1], len(where), axis=0)
                    changed[np.arange(len(where)), where] = new
                    candidates = np.vstack([candidates, changed])
                sums.append(chunk_errors(np.asarray(xs), np.asarray(ys), np.asarray(cols), mfs, fall, candidates))
            yield pd.Series(sums)

    batches.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "array<double>")(x, y, used, fallback, base, coords, values)


def score_jobs(chunks: DataFrame, jobs: DataFrame, mfs: int, tasks: int | None = None) -> DataFrame:
    """(job keys, rows, errors): mean absolute error of each candidate of each job.

    `jobs` has `used`, `fallback`, `base`, `coords`, `values`. The work is spread by job and chunk.
    """
    tasks = tasks or task_count(chunks.sparkSession)
    paired = jobs.select(*JOB_KEYS, "used", "fallback", "base", "coords", "values").join(chunks, "category")
    spread = paired.repartition(tasks, *JOB_KEYS, "chunk")
    sums = error_sums(F.col("x"), F.col("y"), F.col("used"), mfs, F.col("fallback"),
                      F.col("base"), F.col("coords"), F.col("values"))
    scored = spread.select(*JOB_KEYS, F.size("y").alias("rows"), F.posexplode(sums).alias("candidate", "error"))
    per_candidate = scored.groupBy(*JOB_KEYS, "candidate").agg(
        F.sum("rows").alias("rows"), exact_sum(F.col("error")).alias("error")
    )
    # One group is the candidates of one job, whose number the search settings fix.
    return per_candidate.groupBy(*JOB_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("candidate", (F.col("error") / F.col("rows")).alias("mae"))))["mae"]
        .alias("errors")
    )

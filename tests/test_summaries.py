"""Summaries in fixed point: equal to the last bit for every partitioning, and right."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidecast.functions.scalars import fixed_mean, fixed_std, fixed_sums
from tidecast.operators import summaries
from tidecast.operators.evaluate import METRICS


@pytest.fixture(scope="module")
def metrics(spark):
    rng = random.Random(5)
    made = [
        (c, "efs", v, "b", s, *[None if rng.random() < 0.02 else rng.choice([1e-2, 1.0, 1e3]) * (0.1 + rng.random()) for _ in METRICS])
        for c in "abcdefg" for v in ("sales_only", "target_weather") for s in range(20)
    ]
    columns = ", ".join(f"{m} double" for m in METRICS)
    return spark.createDataFrame(made, f"category string, model string, variant string, backend string, seed bigint, {columns}").cache()


@pytest.mark.parametrize("summary,times", [("category_summary", 20), ("macro_summary", 4), ("ablation_summary", 4)])
def test_bits_do_not_depend_on_the_partitioning(metrics, summary, times):
    def rows(df):
        made = summaries.covariate_ablation(df) if summary == "ablation_summary" else df
        return sorted(map(repr, getattr(summaries, summary)(made).collect()))

    first = rows(metrics)
    for i in range(times):
        assert rows(metrics.orderBy(F.xxhash64(F.lit(i), "category", "seed", "variant")).repartition(1 + i % 7)) == first


def summed(spark, groups):
    rows = [(i, v) for i, values in enumerate(groups) for v in values]
    sums = spark.createDataFrame(rows, "g int, v double").groupBy("g").agg(fixed_sums(F.col("v")).alias("s"))
    return {r.g: (r.mean, r.std) for r in sums.select("g", fixed_mean(F.col("s")).alias("mean"), fixed_std(F.col("s")).alias("std")).collect()}


def test_values_are_right(spark):
    groups = [
        [1.0, 2.0, 4.0], [5.0], [None, None], [None, 3.0, 5.0],
        [1e6 + 1e-6, 1e6, 1e6 - 1e-6],  # the deviation is far below the mean
        [-1.5, 1.5, -2.25], [0.0, 0.0], [1e12, 3e12], [8e9, 8e9, -8e9],
    ]
    found = summed(spark, groups)
    for i, values in enumerate(groups):
        plain = [v for v in values if v is not None]
        assert found[i][0] == (pytest.approx(statistics.mean(plain), rel=1e-12) if plain else None)
        assert found[i][1] == (pytest.approx(statistics.stdev(plain), rel=1e-3) if len(plain) > 1 else None)
    assert found[4][1] == pytest.approx(1e-6, rel=1e-9)


def test_nan_and_infinity_keep_the_float_forms(spark):
    mean, std = summed(spark, [[1.0, float("nan")]])[0]
    assert mean != mean and std != std
    assert summed(spark, [[1.0, float("inf")]])[0][0] == float("inf")

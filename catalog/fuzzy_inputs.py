"""Inputs and fixed models of the fuzzy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import COVARIATES, LAGS, prepared_demand, table
from tidecast.functions.scalars import clip
from tidecast.operators import features, fuzzy_infer, fuzzy_train

ORDER_FEATURES = ["x1", "x2"]
# A fixed model, so that scoring queries need no training: (feature, mf, center, sigma, scale, lag).
MEMBERSHIPS = [
    (0, 0, 0.25, 0.20, 0.8, 0.05), (0, 1, 0.75, 0.20, 0.7, 0.0),
    (1, 0, 0.25, 0.15, 0.8, 0.0), (1, 1, 0.75, 0.25, 0.9, -0.05),
]
# (rule_id, antecedent, consequent, weight)
RULES = [(1, [0, 0], 0.20, 0.9), (2, [1, 1], 0.85, 1.0), (3, [0, 1], 0.55, 0.6)]
FALLBACK = 0.4
MFS = 2

# Signed antecedents per rule id: 0 leaves the feature out, a negative index negates it.
SIGNED = {1: [0, -1], 2: [2, 0], 3: [-2, 1]}

SALES_FEATURES = [f"sales_lag_{k}" for k in LAGS]
GENOMES = [
    [((i * 7 + k * 13) % 11) / 10 for i in range(8)]
    + [0.3 + ((i * 5 + k * 3) % 8) / 10 for i in range(8)]
    + [((i * 3 + k * 5) % 10) / 10 + 0.01 * k for i in range(8)]
    for k in range(5)
]
# The last genome selects nothing by threshold, so its strongest rule stands in.
GENOMES.append([0.1, 0.2, 0.45, 0.3, 0.45, 0.0, 0.1, 0.2] + [0.5] * 8 + [0.35] * 8)


def order_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: scaled mean discount and mean quantity."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        clip(F.avg("l_discount") * 10).alias("x1"), clip(F.avg("l_quantity") / 50).alias("x2")
    )


def fixed_model(spark: SparkSession) -> DataFrame:
    return fuzzy_infer.literal_model(spark, ORDER_FEATURES, MEMBERSHIPS, RULES, FALLBACK)


def narrow_model(spark: SparkSession) -> DataFrame:
    narrow = [(f, m, center, sigma / 10, scale, lag / 10) for f, m, center, sigma, scale, lag in MEMBERSHIPS]
    return fuzzy_infer.literal_model(spark, ORDER_FEATURES, narrow, RULES, FALLBACK)


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.make_supervised(prepared_demand(spark, sf_dir), LAGS, COVARIATES)


def variants() -> dict[str, list[str]]:
    return features.feature_variants(LAGS, COVARIATES)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_train.training_rows(supervised(spark, sf_dir), variants())


def series_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untrained models per series and variant."""
    return fuzzy_train.initial_models(training_rows(spark, sf_dir), variants(), MFS)

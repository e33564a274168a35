"""Training jobs by identity: fit what is new, reuse what is the same, refuse what only looks the same."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.features import TEST, TRAIN
from tidecast.operators.fuzzy_score import JOB_KEYS
from tidecast.operators.fuzzy_train import train_it2
from tidecast.plans.config import FuzzyConfig
from tidecast.sources import merkle
from tidecast.sources.models import checked, stamped


def training_jobs(
    supervised: DataFrame, variants: dict[str, list[str]], seeds: list[int], cfg: FuzzyConfig
) -> DataFrame:
    """One row per (category, variant, seed) with the identity of its inputs and settings.

    Inputs enter as the digests of the series' training and test rows, see `merkle`.
    """
    digests = [
        merkle.in_time_order("date", merkle.leaf(supervised.schema, ["date", *names, "target_norm"]), F.col("split") == split)
        .alias(f"{split}_{variant}")
        for variant, names in variants.items() for split in (TRAIN, TEST)
    ]
    series = supervised.groupBy("category").agg(*digests, F.count_if(F.col("split") == TRAIN).alias("train_rows"))
    cells = F.array(*[
        F.struct(F.lit(variant).alias("variant"), F.lit(json.dumps(names)).alias("features"),
                 F.col(f"train_{variant}").alias("train"), F.col(f"test_{variant}").alias("test"),
                 F.lit(s).cast("long").alias("seed"))
        for variant, names in variants.items() for s in seeds
    ])
    jobs = series.filter("train_rows > 0").select("category", F.inline(cells))
    identity = F.sha2(F.concat_ws(
        "|", F.lit("1"), "features", F.lit("target_norm"), F.col("seed").cast("string"),
        F.lit(json.dumps(asdict(cfg), sort_keys=True)), "train", "test",
    ), 256)
    return jobs.select(*JOB_KEYS, identity.alias("identity"))


def refused_unless(models: DataFrame, holds: Column, message: str) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit(message), F.concat_ws("/", *JOB_KEYS))).cast("boolean")
    return models.filter(F.when(holds, True).otherwise(wrong))


def fit_or_reuse(
    supervised: DataFrame, variants: dict[str, list[str]], seeds: list[int], cfg: FuzzyConfig,
    cache: DataFrame | None = None, on_change: str = "raise",
) -> DataFrame:
    """Stamped models with their identity; cached ones only if identity, content and digest hold.

    A job whose inputs or settings changed stops the run (`"raise"`) or is fitted anew, it alone (`"refit"`).
    """
    jobs = training_jobs(supervised, variants, seeds, cfg)
    if cache is None:
        return stamped(train_it2(supervised, variants, seeds, cfg).join(jobs, JOB_KEYS))
    whole = F.col("rules").isNotNull() & F.col("memberships").isNotNull() & F.col("stage_3").isNotNull()
    kept = checked(refused_unless(cache, whole, "Cached result is incomplete: "))
    paired = kept.withColumnRenamed("identity", "cached_identity").join(jobs, JOB_KEYS)
    same = F.coalesce(F.col("identity") == F.col("cached_identity"), F.lit(False))
    refit = on_change == "refit"
    reused = paired.filter(same) if refit else refused_unless(paired, same, "Cached job identity mismatch: ")
    reused = reused.drop("cached_identity")
    known = [*JOB_KEYS, "identity"] if refit else JOB_KEYS
    missing = jobs.join(cache.select(*known), known, "left_anti")
    fitted = stamped(train_it2(supervised, variants, seeds, cfg, only=missing).join(jobs, JOB_KEYS))
    return reused.select(*fitted.columns).unionByName(fitted)

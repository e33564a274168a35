"""Checks over the tables of one run: every check is a DataFrame (check, model_key, ok, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.fuzzy_score import JOB_KEYS
from tidecast.plans.config import MODELS
from tidecast.sources.models import model_digest
from tidecast.sources.runs import manifests, run_table

VARIANTS = ["sales_only", "target_weather"]
EDGE = 1e-12


def key_text(keys: list[str]):
    return F.concat_ws("/", *keys)


def checked(df: DataFrame, name: str, ok, detail, keys: list[str] | None = None) -> DataFrame:
    key = key_text(keys) if keys else F.lit(None).cast("string")
    return df.select(F.lit(name).alias("check"), key.alias("model_key"),
                     F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"))


def expected(spark: SparkSession, names: list[str], column: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def present_models(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per required model: is it in the metrics table?"""
    found = metrics.select("model").distinct().withColumn("found", F.lit(True))
    wanted = expected(metrics.sparkSession, names, "model").join(found, "model", "left")
    return checked(wanted, "required_model", F.col("found"), F.col("model"))


def fuzzy_variants(metrics: DataFrame) -> DataFrame:
    """Variants of the fuzzy model against the expected ones, both ways."""
    found = metrics.filter(F.col("model") == "efs").select("variant").distinct().withColumn("found", F.lit(True))
    wanted = expected(metrics.sparkSession, VARIANTS, "variant").withColumn("wanted", F.lit(True))
    both = wanted.join(found, "variant", "full_outer")
    return checked(both, "fuzzy_variant", F.col("found") & F.col("wanted"), F.col("variant"))


def activation_checks(activations: DataFrame, keys: list[str]) -> DataFrame:
    """Per model: activations finite, inside [0, 1], and at least one rule answers to its inputs.

    Two aggregations, per rule and then per model; the first combines map-side.
    """
    value = F.col("activation")
    finite = F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    rules = activations.groupBy(*keys, "rule_id").agg(
        F.count(F.lit(1)).alias("samples"), F.bool_and(finite).alias("finite"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("spread"),
    )
    models = rules.groupBy(*keys).agg(
        F.max("samples").alias("samples"), F.bool_and("finite").alias("finite"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.max("spread").alias("spread"),
    )
    inside = (F.col("low") >= -EDGE) & (F.col("high") <= 1 + EDGE)
    checks = F.array(
        F.struct(F.lit("activation_finite").alias("check"), F.col("finite").alias("ok"), F.col("samples").cast("double").alias("value")),
        F.struct(F.lit("activation_range").alias("check"), inside.alias("ok"), F.col("high").alias("value")),
        F.struct(F.lit("activation_responds").alias("check"), (F.col("spread") > EDGE).alias("ok"), F.col("spread").alias("value")),
    )
    return models.select(*keys, F.inline(checks))


def support_checks(rules: DataFrame, activations: DataFrame, keys: list[str]) -> DataFrame:
    """Per model: rules whose support lies outside 0 .. sample count, or that have no sample at all."""
    samples = activations.groupBy(*keys, "rule_id").agg(F.count(F.lit(1)).alias("samples"))
    inside = F.col("support").between(F.lit(0), F.col("samples"))
    outside = ~F.coalesce(inside, F.lit(False))
    return rules.join(samples, [*keys, "rule_id"], "left").groupBy(*keys).agg(F.count_if(outside).alias("outside"))


def missing_outputs(jobs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a row in an output table."""
    return jobs.join(outputs.select(*keys).distinct(), keys, "left_anti")


def verify_run(
    spark: SparkSession, root: str, run_id: str | None = None, models: list[str] | None = None, strict: bool = False
) -> DataFrame:
    """All checks of a run (the last one by default); strict mode raises on the first failed check."""
    latest = manifests(spark, root)
    if run_id is None:
        newest = latest.agg(F.max("run_id").alias("run_id")).first()["run_id"]
        if newest is None:
            raise RuntimeError(f"No run manifest found below {root}")
        run_id = newest
    manifest = latest.filter(F.col("run_id") == run_id)

    def tables(*names: str) -> list[DataFrame]:
        return [run_table(spark, root, name, run_id) for name in names]

    def failed(checks: DataFrame) -> None:
        if strict and (first := checks.filter(~F.col("ok")).orderBy("check", "model_key").first()):
            raise RuntimeError(f"{first['check']} failed: {first['model_key'] or ''} {first['detail'] or ''}")

    opened = checked(manifest, "manifest_complete", F.col("status") == "complete", F.col("status")).unionByName(
        checked(manifest, "manifest_data_sha256", F.length("data_sha256") == 64, F.col("data_sha256")))
    failed(opened)
    metrics, unavailable = tables("metrics", "unavailable")
    noted = unavailable.select(F.lit("unavailable").alias("check"), F.concat_ws("/", "category", "model").alias("model_key"),
                               F.lit(False).alias("ok"), F.col("reason").alias("detail"))
    found = present_models(metrics, models or MODELS).unionByName(fuzzy_variants(metrics)).unionByName(noted)
    failed(found)
    jobs, fitted, predictions, rules, activations = tables("jobs", "models", "fuzzy_predictions", "rules", "activations")
    outputs = [
        checked(missing_outputs(jobs, table, JOB_KEYS), f"output_{name}", F.lit(False), F.lit("missing"), JOB_KEYS)
        for name, table in (("models", fitted), ("predictions", predictions), ("rules", rules), ("activations", activations))
    ]
    per_model = [
        checked(fitted, "model_sha256", F.col("model_sha256") == model_digest(), F.col("model_sha256"), JOB_KEYS),
        checked(fitted, "upper_parameters_locked", F.col("upper_parameters_locked"), F.col("upper_parameter_max_delta"), JOB_KEYS),
        activation_checks(activations, JOB_KEYS).select(
            "check", key_text(JOB_KEYS).alias("model_key"), F.coalesce("ok", F.lit(False)).alias("ok"),
            F.col("value").cast("string").alias("detail")),
        checked(support_checks(rules, activations, JOB_KEYS), "rule_support", F.col("outside") == 0, F.col("outside"), JOB_KEYS),
    ]
    detailed = reduce(DataFrame.unionByName, [*outputs, *per_model])
    failed(detailed)
    return opened.unionByName(found).unionByName(detailed)

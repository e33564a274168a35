"""A whole audited run: read, prepare, forecast, score, summarise, explain, record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import evaluate, explain, features, summaries
from tidecast.operators.fuzzy_score import JOB_KEYS
from tidecast.operators.rounds import durable
from tidecast.plans.config import RunConfig
from tidecast.plans.forecasting import fuzzy_activations, fuzzy_predictions, run_forecasters, unavailable_models
from tidecast.sources.demand import read_demand
from tidecast.sources.fingerprints import data_identity
from tidecast.sources.paths import base_name, resolve_source
from tidecast.sources.runs import finish_manifest, open_run, write_run_table

SUMMARY_FIELDS = ["training_rows", "training_mae_norm", "upper_parameter_max_delta", "upper_parameters_locked",
                  "stage_1", "stage_2", "stage_3"]


def preprocessing_table(prepared: DataFrame, config: RunConfig) -> DataFrame:
    """Per series and variant: feature list, scales and medians as maps, input policy."""
    stats = features.feature_stats(prepared, config.weather_features)
    # A group is the features of one series.
    scales = F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", F.struct("minimum", "maximum")))))
    medians = F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "median"))))
    series = stats.groupBy("category").agg(scales.alias("scales"), medians.alias("training_medians"))
    variants = features.feature_variants(config.lags, config.weather_features)
    cells = F.array(*[
        F.struct(F.lit(v).alias("variant"), F.array(*[F.lit(n) for n in names]).alias("feature_columns"))
        for v, names in variants.items()
    ])
    return series.select(
        "category", F.inline(cells), F.lit(1).alias("schema_version"),
        F.lit("training_minmax_then_clip_0_1").alias("input_policy"), "scales", "training_medians",
    )


def training_summary(models: DataFrame, trained: DataFrame, predictions: DataFrame, elapsed: float | None) -> DataFrame:
    """Training record per model with its silent training and test samples.

    `elapsed_seconds` is the wall time of the training that made the models: all jobs of a run train together.
    """
    def silent(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*JOB_KEYS).agg(F.count_if("no_rule_fired").alias(name))

    fields = models.select(
        *JOB_KEYS, "backend", F.size("feature_columns").alias("num_inputs"), F.col("mfs").alias("num_input_mfs"),
        F.size("rules").alias("num_rules"), *SUMMARY_FIELDS, F.lit(elapsed).cast("double").alias("elapsed_seconds"),
    )
    known = fields.join(silent(trained, "training_no_rule_samples"), JOB_KEYS, "left")
    return known.join(silent(predictions, "test_no_rule_samples"), JOB_KEYS, "left")


def run_benchmark(
    spark: SparkSession, config: RunConfig, cache: DataFrame | None = None, label: str = "benchmark",
    on_error: str = "raise",
) -> str:
    """Run a configuration and return its run id; all tables lie under `config.artifact_root`.

    With `on_error="record"` an unusable series becomes an unavailable row instead of ending the run.
    """
    root = config.artifact_root
    path = resolve_source(spark, config.data_path)
    demand = read_demand(spark, path)
    if config.categories != "all" and (lost := features.absent_categories(demand, config.categories).first()):
        raise ValueError(f"{lost['category']}: both {config.train_year} and {config.test_year} data are required")
    demand = features.select_categories(demand, config.categories)
    run_id = open_run(spark, root, label, config.to_dict(), base_name(path), data_identity(demand))

    def store(df: DataFrame, table: str) -> DataFrame:
        return write_run_table(df, root, table, run_id)

    years = (config.train_year, config.test_year, config.weather_features)
    prepared = durable(features.prepare_features(demand, *years, on_error="raise" if on_error == "raise" else "drop"))
    forecasts = run_forecasters(prepared, config, cache)
    aligned = durable(forecasts.aligned)
    store(evaluate.predictions_table(aligned), "predictions")
    metrics = store(evaluate.metrics_table(aligned), "metrics")
    categories = store(prepared.select("category").distinct(), "categories")
    unavailable = unavailable_models(categories, metrics, config)
    if on_error == "record":
        broken = features.series_problems(demand, *years).select(
            "category", F.lit("all").alias("model"), F.lit("spark").alias("backend"), "reason")
        unavailable = unavailable.unionByName(broken)
    unavailable = store(unavailable, "unavailable")
    store(preprocessing_table(prepared, config), "preprocessing")
    if forecasts.fit_details is not None:
        store(forecasts.fit_details, "fit_details")
    store_summaries(store, metrics)
    if forecasts.models is not None:
        store_fuzzy(store, forecasts, config)
    finish_manifest(spark, root, run_id, categories.count(), metrics.count(), unavailable.count())
    return run_id


def store_summaries(store, metrics: DataFrame) -> None:
    store(summaries.category_summary(metrics), "category_summary")
    store(summaries.macro_metrics(metrics), "macro_metrics")
    store(summaries.macro_summary(metrics), "macro_summary")
    ablation = store(summaries.covariate_ablation(metrics), "weather_ablation")
    store(summaries.ablation_summary(ablation), "weather_ablation_summary")


def store_fuzzy(store, forecasts, config: RunConfig) -> None:
    """Models, predictions, long activations, rules and training summaries of the fuzzy model."""
    variants = features.feature_variants(config.lags, config.weather_features)
    models = store(forecasts.models, "models")
    store(models.select(*JOB_KEYS, "identity"), "jobs")
    test, train = (durable(forecasts.supervised.filter(F.col("split") == s)) for s in (features.TEST, features.TRAIN))
    predictions = store(fuzzy_predictions(test, models, variants), "fuzzy_predictions")
    activations = store(fuzzy_activations(test, models, variants), "activations")
    store(explain.explain(models, activations, JOB_KEYS), "rules")
    trained = fuzzy_predictions(train, models, variants)
    store(training_summary(models, trained, predictions, forecasts.training_seconds), "training_summary")

"""All forecasters of a configuration over prepared demand."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import arima, evaluate, features, fuzzy_infer, lstm
from tidecast.operators.forecasts import BACKEND, FUZZY_BACKEND, MODEL_KEYS, tagged, to_both_scales
from tidecast.operators.fuzzy_score import JOB_KEYS
from tidecast.operators.rounds import durable
from tidecast.plans.config import RunConfig
from tidecast.plans.jobs import fit_or_reuse

# Why an expected series has no forecast of a model.
REASONS = {
    "seasonal_naive": "no observed test target after the first season",
    "arima": "ARIMA search did not produce a valid fitted model",
    "lstm": "LSTM needs at least two training rows",
    "efs": "fuzzy training needs at least one training row",
}
NO_TOOLBOX = "The licensed toolbox backend cannot run on executors; use backend spark-it2"


@dataclass
class Forecasts:
    """Tables of one forecasting pass."""

    aligned: DataFrame
    supervised: DataFrame
    fit_details: DataFrame | None = None
    models: DataFrame | None = None
    training_seconds: float | None = None


def fuzzy_scored(evaluate, test: DataFrame, models: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Test rows of every series through each of its models: variants and seeds."""
    parts = []
    for variant, names in variants.items():
        own = models.filter(F.col("variant") == variant)
        rows = test.join(own.select(*JOB_KEYS), "category")
        parts.append(evaluate(rows, names, [*JOB_KEYS, "date"], own, tuple(JOB_KEYS)))
    return reduce(DataFrame.unionByName, parts)


def fuzzy_predictions(test: DataFrame, models: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """(job keys, date, prediction_norm, no_rule_fired) of every model on its test rows."""
    return fuzzy_scored(fuzzy_infer.it2_predict, test, models, variants)


def fuzzy_activations(test: DataFrame, models: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    return fuzzy_scored(fuzzy_infer.rule_activations, test, models, variants)


def fuzzy_forecast(predictions: DataFrame, supervised: DataFrame) -> DataFrame:
    scales = supervised.groupBy("category").agg(
        F.max("sales_min").alias("sales_min"), F.max("sales_max").alias("sales_max"))
    rows = predictions.withColumnRenamed("prediction_norm", "predicted_norm").join(scales, "category")
    return tagged(to_both_scales(rows), "efs", F.col("variant"), FUZZY_BACKEND, F.col("seed"))


def run_forecasters(prepared: DataFrame, config: RunConfig, cache: DataFrame | None = None) -> Forecasts:
    """Forecasts of all configured models beside their truth, in one long table."""
    truth = evaluate.truth_table(prepared, max(config.lags), config.seasonal_period, config.seasonal_period)
    supervised = features.make_supervised(prepared, config.lags, config.weather_features)
    aligned, forecasts, details = [], [], []
    result = Forecasts(aligned=truth, supervised=supervised)
    keys = {"model": F.lit("arima"), "variant": F.lit("sales_only"), "backend": F.lit(BACKEND),
            "seed": F.lit(None).cast("long")}
    if "seasonal_naive" in config.models:
        aligned.append(evaluate.naive_aligned(truth))
        period = F.create_map(F.lit("period"), F.lit(str(config.seasonal_period)))
        details.append(prepared.select("category").distinct().withColumns(
            {**keys, "model": F.lit("seasonal_naive"), "details": period}))
    if "arima" in config.models:
        best = durable(arima.arima_select(prepared, config.profile))
        forecasts.append(arima.arima_roll(best, prepared))
        details.append(best.withColumns({**keys, "details": arima.arima_details()}))
    if "lstm" in config.models:
        networks = lstm.train_lstm(supervised, config.lags, config.seeds, config.profile)
        forecasts.append(lstm.lstm_forecast(supervised, networks, config.lags))
        details.append(networks.withColumns(
            {**keys, "model": F.lit("lstm"), "seed": F.col("seed"), "details": lstm.lstm_details()}))
    if "efs" in config.models and config.efs.backend != "matlab":
        variants = features.feature_variants(config.lags, config.weather_features)
        began = time.perf_counter()
        result.models = durable(fit_or_reuse(supervised, variants, config.seeds, config.efs, cache))
        result.training_seconds = time.perf_counter() - began
        test = supervised.filter(F.col("split") == features.TEST)
        scored = fuzzy_predictions(test, result.models, variants)
        forecasts.append(fuzzy_forecast(scored, supervised))
    if forecasts:
        joined = evaluate.align(reduce(DataFrame.unionByName, forecasts), truth)
        aligned.append(joined)
    result.aligned = reduce(DataFrame.unionByName, aligned)
    if details:
        result.fit_details = reduce(DataFrame.unionByName, [d.select(*MODEL_KEYS, "details") for d in details])
    return result


def unavailable_models(categories: DataFrame, metrics: DataFrame, config: RunConfig) -> DataFrame:
    """One row (category, model, backend, reason) per expected model without metrics.

    The reference list is categories x configured models, made by an explode of the short list.
    """
    toolbox = config.efs.backend == "matlab"
    cells = []
    for model in config.models:
        if model != "efs":
            cells.append((model, "sales_only", model, BACKEND, REASONS[model]))
            continue
        for variant in features.feature_variants(config.lags, config.weather_features):
            cells.append((model, variant, f"efs:{variant}", "matlab" if toolbox else FUZZY_BACKEND,
                          NO_TOOLBOX if toolbox else REASONS["efs"]))
    names = ["model", "variant", "label", "backend", "reason"]
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c, strict=True)]) for c in cells])
    wanted = categories.select("category", F.inline(listed))
    absent = wanted.join(metrics.select("category", "model", "variant").distinct(), ["category", "model", "variant"], "left_anti")
    return absent.select("category", F.col("label").alias("model"), "backend", "reason")

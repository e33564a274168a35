"""Scoring of streams: a saved model is one projection, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidecast.operators.fuzzy_infer import predict_saved


def score_stream(
    models: DataFrame, stream: DataFrame, features: list[str], keys: tuple[str, ...] = ("date",)
) -> DataFrame:
    """Predictions of one saved model for a streaming DataFrame with the key columns and the features."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame")
    return predict_saved(models, stream, features, keys)

"""Rule tables: text, labels and activation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import labels

SUPPORT_ACTIVATION = 0.01


def rule_rows(models: DataFrame, keys: list[str]) -> DataFrame:
    """Models as one row per rule, with the model's feature names."""
    return models.select(*keys, "feature_columns", F.inline("rules"))


def rule_text(models: DataFrame, keys: list[str]) -> DataFrame:
    text = labels.rule_text(F.col("feature_columns"), F.col("antecedent"))
    return rule_rows(models, keys).select(*keys, "rule_id", text.alias("antecedent"))


def signed_rule_text(rules: DataFrame, keys: list[str], mfs: int) -> DataFrame:
    """Text of rules with signed 1-based antecedents (0 = feature not used, negative = NOT)."""
    text = labels.signed_rule_text(F.col("feature_columns"), F.col("antecedent"), mfs)
    return rules.select(*keys, "rule_id", text.alias("antecedent"))


def consequent_labels(models: DataFrame, keys: list[str]) -> DataFrame:
    label = labels.consequent_label(F.col("consequent"))
    return rule_rows(models, keys).select(*keys, "rule_id", label.alias("consequent"))


def closed_consequent_labels(models: DataFrame, keys: list[str]) -> DataFrame:
    """Title-case labels; a repeated label of one model gets _2, _3, ... in output order.

    A group is the rules of one model, whose number the candidate-rule limit bounds.
    """
    labelled = rule_rows(models, keys).withColumn("label", labels.closed_consequent_label(F.col("consequent")))
    nth = F.row_number().over(Window.partitionBy(*keys, "label").orderBy("rule_id"))
    numbered = F.when(F.col("nth") > 1, F.concat("label", F.lit("_"), F.col("nth"))).otherwise(F.col("label"))
    return labelled.withColumn("nth", nth).select(*keys, "rule_id", numbered.alias("consequent"))


def rule_stats(activations: DataFrame, keys: list[str]) -> DataFrame:
    """Support, mean and maximum activation per rule; summed map-side before the shuffle."""
    return activations.groupBy(*keys, "rule_id").agg(
        F.count_if(F.col("activation") > SUPPORT_ACTIVATION).alias("support"),
        F.avg("activation").alias("mean_activation"), F.max("activation").alias("max_activation"),
    )


def explain(models: DataFrame, activations: DataFrame, keys: list[str]) -> DataFrame:
    """Rule table: text, label, weight and what the activations say of each rule."""
    described = rule_rows(models, keys).select(
        *keys, "rule_id",
        labels.rule_text(F.col("feature_columns"), F.col("antecedent")).alias("antecedent"),
        labels.consequent_label(F.col("consequent")).alias("consequent"),
        F.col("consequent").alias("consequent_value_norm"), "weight",
    )
    return described.join(rule_stats(activations, keys), [*keys, "rule_id"], "left")


def activation_matrix(activations: DataFrame, keys: list[str]) -> DataFrame:
    """Heat-map cells (keys, sample_index, rule_id, activation), samples numbered by date.

    Every sample has a row for every rule, so numbering inside (keys, rule) gives one index per
    date and keeps a group to the days of one model's test year.
    """
    by_date = Window.partitionBy(*keys, "rule_id").orderBy("date")
    return activations.select(
        *keys, (F.row_number().over(by_date) - 1).alias("sample_index"), "rule_id", "activation"
    )

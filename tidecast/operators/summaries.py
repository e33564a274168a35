"""Summary and ablation tables over the metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalars import fixed_mean, fixed_std, fixed_sums
from tidecast.operators.evaluate import METRICS


def with_backend(df: DataFrame) -> DataFrame:
    """Older tables have no backend column; theirs is `unspecified`."""
    return df if "backend" in df.columns else df.withColumn("backend", F.lit("unspecified"))


def summed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key with the fixed-point sums of each column: equal for every order and partitioning."""
    return rows.groupBy(*keys).agg(*[fixed_sums(F.col(c)).alias(c) for c in columns])


def mean_and_std(columns: list[str]) -> list:
    """Mean and sample deviation of summed columns."""
    return [
        of(F.col(c)).alias(f"{c}_{name}")
        for c in columns for name, of in (("mean", fixed_mean), ("std", fixed_std))
    ]


def category_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds."""
    keys = ["category", "model", "variant", "backend"]
    return summed(with_backend(metrics), keys, METRICS).select(*keys, *mean_and_std(METRICS))


def macro_metrics(metrics: DataFrame) -> DataFrame:
    """Mean over categories per seed."""
    keys = ["model", "variant", "backend", "seed"]
    return summed(with_backend(metrics), keys, METRICS).select(*keys, *[fixed_mean(F.col(c)).alias(c) for c in METRICS])


def macro_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds of the macro means."""
    keys = ["model", "variant", "backend"]
    return summed(macro_metrics(metrics), keys, METRICS).select(*keys, *mean_and_std(METRICS))


def covariate_ablation(metrics: DataFrame) -> DataFrame:
    """Fuzzy model with against without covariates, per (category, backend, seed).

    Both variants of a key meet in one aggregation, so the table is shuffled once and a NULL seed
    pairs with a NULL seed.
    """
    fuzzy = with_backend(metrics).filter(F.col("model") == "efs")

    def of(variant: str, column: str):
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    def has(variant: str):
        return F.bool_or(F.col("variant") == variant)

    paired = fuzzy.groupBy("category", "backend", "seed").agg(
        *[of(v, m).alias(f"{m}_{v}") for m in METRICS for v in ("sales_only", "target_weather")],
        (has("sales_only") & has("target_weather")).alias("is_pair"),
    ).filter("is_pair")
    cells = []
    for m in METRICS:
        before, after = F.col(f"{m}_sales_only"), F.col(f"{m}_target_weather")
        gain = F.when(before != 0, (before - after) * 100 / before)
        cells += [before, after, gain.alias(f"{m}_improvement_pct")]
    return paired.select("category", "backend", "seed", *cells)


def ablation_summary(ablation: DataFrame) -> DataFrame:
    """One row per numeric ablation column: measure, mean, std, in the column order."""
    measures = [c for c in ablation.columns if c not in ("category", "backend", "seed")]
    long = ablation.select(F.posexplode(F.array(*measures)).alias("position", "value"))
    named = F.element_at(F.array(*[F.lit(m) for m in measures]), F.col("position") + 1)
    return summed(long, ["position"], ["value"]).select(
        "position", named.alias("measure"), fixed_mean(F.col("value")).alias("mean"), fixed_std(F.col("value")).alias("std")
    )

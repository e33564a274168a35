"""Semantic labels of memberships, rules and outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.functions.scalars import clip

# Output labels from low to high, in both spellings.
LEVELS = ["critical_low", "low", "medium", "high", "peak"]
TITLE_LEVELS = ["Critical_Low", "Low", "Medium", "High", "Peak"]


def membership_label(mf: Column) -> Column:
    """low, high, then mf_3, mf_4, ... for a 0-based membership index."""
    return F.when(mf == 0, "low").when(mf == 1, "high").otherwise(
        F.concat(F.lit("mf_"), (mf + 1).cast("string"))
    )


def signed_membership_label(mf: Column, mfs: int) -> Column:
    """Low/High for two memberships, else Level_i, for a 1-based index."""
    level = F.concat(F.lit("Level_"), mf.cast("string"))
    return F.when(mf == 1, "Low").when(mf == 2, "High").otherwise(level) if mfs == 2 else level


def rule_text(features: Column, antecedent: Column) -> Column:
    """`f is low AND g is high`."""
    return F.array_join(F.zip_with(
        features, antecedent, lambda name, mf: F.concat(name, F.lit(" is "), membership_label(mf))
    ), " AND ")


def signed_rule_text(features: Column, antecedent: Column, mfs: int) -> Column:
    """As `rule_text` for signed 1-based indices: 0 is left out, a negative one reads `NOT `."""
    clauses = F.zip_with(features, antecedent, lambda name, mf: F.when(mf != 0, F.concat(
        F.when(mf < 0, "NOT ").otherwise(""), name, F.lit(" is "), signed_membership_label(F.abs(mf), mfs),
    )))
    return F.array_join(F.array_compact(clauses), " AND ")


def consequent_label(value: Column) -> Column:
    """Five half-open bins of [0, 1]; outside values go to the outer bins."""
    bins = len(LEVELS)
    index = F.least(F.floor(clip(value) * bins), F.lit(bins - 1)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in LEVELS]), index + 1)


def closed_consequent_label(value: Column) -> Column:
    """Five bins whose upper edge belongs to them; values outside [0, 1] are `Outside_Range`."""
    # Upper bin edges.
    edges = [0.2, 0.4, 0.6, 0.8, 1.0]
    label = F.when(~value.between(0, 1) | value.isNull(), "Outside_Range")
    for edge, name in zip(edges, TITLE_LEVELS, strict=True):
        label = label.when(value <= edge, name)
    return label

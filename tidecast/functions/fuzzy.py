"""Interval type-2 fuzzy models: their tables, and membership degrees as column expressions.

A model is two arrays: `memberships` (feature, mf, center, sigma, lower_scale, lower_lag), ordered
by feature and mf, and `rules` (rule_id, antecedent, consequent, weight), ordered by consequent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_FIRING = 1e-12

MEMBERSHIP_TYPE = (
    "array<struct<feature:int,mf:int,center:double,sigma:double,lower_scale:double,lower_lag:double>>"
)
RULE_TYPE = "array<struct<rule_id:int,antecedent:array<int>,consequent:double,weight:double>>"


def bell(value: Column, center: Column, sigma: Column) -> Column:
    z = (value - center) / sigma
    return F.exp(z * z * -0.5)


def membership_pair(
    value: Column, center: Column, sigma: Column, lower_scale: Column, lower_lag: Column
) -> tuple[Column, Column]:
    """Lower and upper degree of a value in [0, 1]. The upper degree of a NULL is NULL."""
    upper = bell(value, center, sigma)
    shifted = lower_scale * bell(value, center + lower_lag, sigma)
    return F.greatest(F.lit(0.0), F.least(upper, shifted)), upper

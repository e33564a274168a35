"""Random draws as column expressions.

A draw is a hash of its coordinates (seed, stage, round, position ...), so it depends on nothing
else: the same run gives the same numbers under any partitioning and after any task retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*coordinates: Column | int | str) -> Column:
    """Uniform draw in [0, 1)."""
    parts = [c if isinstance(c, Column) else F.lit(c) for c in coordinates]
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(2.0**53)


def normal(*coordinates: Column | int | str) -> Column:
    """Standard normal draw (Box-Muller)."""
    radius = F.sqrt(F.log(1 - uniform(*coordinates, "radius")) * -2)
    return radius * F.cos(uniform(*coordinates, "angle") * (2 * math.pi))


def choice(size: int, *coordinates: Column | int | str) -> Column:
    """Index drawn from 0 .. size-1."""
    return F.floor(uniform(*coordinates) * size).cast("int")

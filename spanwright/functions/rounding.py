"""Rounding as page geometry needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def snap(c: Column, ladder: list[float]) -> Column:
    """The nearest step of the ladder, the lower of two equally near."""
    steps = F.array(*(F.lit(float(x)) for x in ladder))
    return F.when(c.isNotNull(), F.array_min(F.transform(steps, lambda x: F.struct(F.abs(c - x).alias("off"), x.alias("step"))))["step"])

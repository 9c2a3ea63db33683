"""Boxes as four columns: x1, y1, x2, y2."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str) -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.x2 - self.x1) * F.greatest(F.lit(0.0), self.y2 - self.y1)

    def intersection(self, other: Box) -> Column:
        w = F.least(self.x2, other.x2) - F.greatest(self.x1, other.x1)
        h = F.least(self.y2, other.y2) - F.greatest(self.y1, other.y1)
        return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)

    def overlap_of_self(self, other: Box) -> Column:
        """The share of self that other covers."""
        return F.when(self.area > 0, self.intersection(other) / self.area).otherwise(0.0)

    def overlap_of_smaller(self, other: Box) -> Column:
        least = F.least(self.area, other.area)
        return F.when(least > 0, self.intersection(other) / least).otherwise(0.0)

    def contains(self, other: Box) -> Column:
        return (self.x1 <= other.x1) & (self.y1 <= other.y1) & (self.x2 >= other.x2) & (self.y2 >= other.y2)


def letterbox(box: Box, source: tuple[Column, Column], target: tuple[Column, Column]) -> Box:
    """The box scaled to fit a source page into a target page, centred."""
    scale = F.least(target[0] / source[0], target[1] / source[1])
    dx, dy = (target[0] - source[0] * scale) / 2, (target[1] - source[1] * scale) / 2
    return Box(box.x1 * scale + dx, box.y1 * scale + dy, box.x2 * scale + dx, box.y2 * scale + dy)


def aspect_penalty(w: Column, h: Column) -> Column:
    return F.abs(F.log(F.greatest(F.lit(0.01), F.least(F.lit(100.0), w / h))))

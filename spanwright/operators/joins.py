"""Joins that Spark has no operator for: boxes by grid, values by nearest step, corrections by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def box_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float, left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    """Pairs of boxes of equal keys that touch one another, as an equi join on grid cells. Columns get the prefixes; boxes are x1, y1, x2, y2.
    A pair that shares several cells is kept in the one that holds the corner of its intersection. cell should be about the
    size of a common box; it sets the cost and never the result."""
    def cut(df: DataFrame, p: str) -> DataFrame:
        d = df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))
        d = d.withColumn(f"{p}cx", F.explode(_cells(F.col(f"{p}x1"), F.col(f"{p}x2"), cell)))
        return d.withColumn(f"{p}cy", F.explode(_cells(F.col(f"{p}y1"), F.col(f"{p}y2"), cell)))

    a, b = left_prefix, right_prefix
    lc, rc = cut(left, a), cut(right, b)
    on = (F.col(f"{a}cx") == F.col(f"{b}cx")) & (F.col(f"{a}cy") == F.col(f"{b}cy"))
    for k in keys:
        on &= F.col(f"{a}{k}") == F.col(f"{b}{k}")
    corner = (F.col(f"{a}cx") == F.floor(F.greatest(f"{a}x1", f"{b}x1") / cell)) & (F.col(f"{a}cy") == F.floor(F.greatest(f"{a}y1", f"{b}y1") / cell))
    meet = (F.col(f"{a}x1") <= F.col(f"{b}x2")) & (F.col(f"{b}x1") <= F.col(f"{a}x2")) & (F.col(f"{a}y1") <= F.col(f"{b}y2")) & (F.col(f"{b}y1") <= F.col(f"{a}y2"))
    return lc.join(rc, on & corner & meet).drop(f"{a}cx", f"{a}cy", f"{b}cx", f"{b}cy")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, width, left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    """Pairs of equal keys whose integer values differ by width at most: the right side is dealt to three buckets of that width."""
    a, b = left_prefix, right_prefix
    lc = left.select(*(F.col(c).alias(f"{a}{c}") for c in left.columns)).withColumn("__lb", F.floor(F.col(f"{a}{value}") / width))
    rc = right.select(*(F.col(c).alias(f"{b}{c}") for c in right.columns))
    at = F.floor(F.col(f"{b}{value}") / width)
    rc = rc.withColumn("__rb", F.explode(F.array(at - 1, at, at + 1)))
    on = F.col("__lb") == F.col("__rb")
    for k in keys:
        on &= F.col(f"{a}{k}") == F.col(f"{b}{k}")
    return lc.join(rc, on & (F.abs(F.col(f"{a}{value}") - F.col(f"{b}{value}")) <= width)).drop("__lb", "__rb")


def without_near(df: DataFrame, row_id: str, keys: list[str], at: str, width: int, value: str, reach: float) -> DataFrame:
    """Rows without a row of another id and equal keys whose whole number at differs by width at most and whose value by reach at most; what is unknown or no finite number is near
    nothing. Rows of a cell that is no wider than both bounds and has two ids have company. Only ids alone in their cell are held against the cells around,
    so a row meets 15 of them at most, however many rows are near one another."""
    known = F.abs(F.col(value)) < float("inf")
    for c in (row_id, *keys, at):
        known &= F.col(c).isNotNull()
    known = F.coalesce(known, F.lit(False))
    side = reach * 0.52  # two steps of this pass reach, one does not
    place = {"__a": F.col(at) - F.pmod(F.col(at), F.lit(width)), "__v": F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.col(value) / side)))}
    d, cell = df.filter(known).withColumns(place), [*keys, "__a", "__v"]
    wide = (F.max(at) - F.min(at) > width) | (F.max(value) - F.min(value) > reach)
    company = d.groupBy(*cell).agg((F.min(row_id) < F.max(row_id)).alias("__two"), wide.alias("__wide")).filter("__two and not __wide").select(*cell)
    alone = d.join(company, cell, "left_anti")
    row = [row_id, *keys, at, value]
    around = alone.select(*row, *cell[len(keys):]).distinct().withColumn("__a", F.explode(F.array(*(F.col("__a") + i * width for i in (-1, 0, 1)))))
    around = around.withColumn("__v", F.explode(F.array(*(F.col("__v") + i for i in range(-2, 3))))).select(*cell, *(F.col(c).alias(f"__own_{c}") for c in (row_id, at, value)))
    near = (F.col(row_id) != F.col(f"__own_{row_id}")) & (F.abs(F.col(at) - F.col(f"__own_{at}")) <= width) & (F.abs(F.col(value) - F.col(f"__own_{value}")) <= reach)
    met = around.join(d, cell).filter(near).select(*keys, *(F.col(f"__own_{c}").alias(c) for c in (row_id, at, value))).distinct()
    return df.filter(~known).unionByName(alone.join(met, row, "left_anti").select(*df.columns))


def correct(base: DataFrame, fixes: DataFrame, keys: list[str], text: str, fix: str) -> DataFrame:
    """base with fixes merged in: outcome skip (no fix), confirm (equal), preserve (empty) or replace, and the text that results."""
    d = base.join(fixes.select(*keys, F.col(fix).alias("__fix")), keys, "left")
    f = F.col("__fix")
    out = F.when(f.isNull(), "skip").when(f == F.col(text), "confirm").when(f == "", "preserve").otherwise("replace")
    return d.withColumn("outcome", out).withColumn("corrected", F.when(F.col("outcome") == "replace", f).otherwise(F.col(text))).drop("__fix")

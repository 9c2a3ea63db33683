"""Ordered-sequence operators. Each works within partitions of the given keys; ties need an order that decides them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list, value: str, gap: float, out: str = "island") -> DataFrame:
    """Number clusters of sorted values from 0; a new one begins where the step from the value before exceeds gap."""
    w = _w(keys, order)
    d = df.withColumn("__new", F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0))
    return d.withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def interval_merge(df: DataFrame, keys: list[str], start: str, end: str, gap, tie: list | None = None) -> DataFrame:
    """(keys, start, end, n): spans merged where the next starts at or before the furthest end so far plus gap."""
    w = _w(keys, [start, end, *(tie or [])])
    d = df.withColumn("__far", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__new", F.when(F.col("__far").isNull() | (F.col(start) > F.col("__far") + F.lit(gap)), 1).otherwise(0))
    d = d.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__group")


def runs(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """(keys, run, value, n): consecutive equal values as one row."""
    w = _w(keys, order)
    d = df.withColumn("__new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1))
    d = d.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run", value).agg(F.count("*").alias("n"))


def nearest_filled(df: DataFrame, keys: list[str], order: str, value: str, empty: Column, out: str = "filled") -> DataFrame:
    """Rows where empty holds take the value of the nearest other row by order; of two equally near, the larger value."""
    v, at = F.when(~empty, F.col(value)), F.when(~empty, F.col(order))
    up = _w(keys, [order]).rowsBetween(Window.unboundedPreceding, -1)
    down = _w(keys, [order]).rowsBetween(1, Window.unboundedFollowing)
    d = df.withColumns({"__pv": F.last(v, True).over(up), "__pa": F.last(at, True).over(up), "__nv": F.first(v, True).over(down), "__na": F.first(at, True).over(down)})
    dp, dn = F.col(order) - F.col("__pa"), F.col("__na") - F.col(order)
    near = F.when(F.col("__pa").isNull(), F.col("__nv")).when(F.col("__na").isNull(), F.col("__pv")).when(dp < dn, F.col("__pv")).when(dn < dp, F.col("__nv")).otherwise(F.greatest("__pv", "__nv"))
    return d.withColumn(out, F.when(empty, near).otherwise(F.col(value))).drop("__pv", "__pa", "__nv", "__na")


def last_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(_w(keys, order))).filter(F.col("__rn") <= n).drop("__rn")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rn") -> DataFrame:
    """The k first rows of each key with their rank. Spark keeps k rows a key and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(_w(keys, order))).filter(F.col(rank) <= k)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first in order: argmin and argmax with ties decided."""
    return top_k(df, keys, order, 1, "__first").drop("__first")


def clip_to_neighbours(df: DataFrame, keys: list[str], order: list, start: str, end: str) -> DataFrame:
    """Cut each interval at the end of the one before and the start of the next, unless nothing would stay."""
    w = _w(keys, order)
    s = F.greatest(F.col(start), F.coalesce(F.lag(end).over(w), F.col(start)))
    e = F.least(F.col(end), F.coalesce(F.lead(start).over(w), F.col(end)))
    d = df.withColumns({"__s": s, "__e": e})
    return d.withColumns({"clip_start": F.when(F.col("__s") < F.col("__e"), F.col("__s")).otherwise(F.col(start)), "clip_end": F.when(F.col("__s") < F.col("__e"), F.col("__e")).otherwise(F.col(end))}).drop("__s", "__e")

"""Queries over boxes derived from embeddings: x = e[0], y = e[1], w = |e[2]| + 0.05, h = |e[3]| + 0.05, one page a label. They are no
layout boxes; they apply the box operators to real columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Box, letterbox
from ..operators import graph, joins, windows
from ..session import table
from .registry import query

SQL = """boxes AS (SELECT vec_id, label, e[1]::DOUBLE AS x1, e[2]::DOUBLE AS y1, e[1]::DOUBLE + abs(e[3]::DOUBLE) + 0.05 AS x2, e[2]::DOUBLE + abs(e[4]::DOUBLE) + 0.05 AS y2 FROM (SELECT vec_id, label, embedding AS e FROM embeddings)),
a AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM boxes),
m AS (SELECT l.vec_id AS l_id, r.vec_id AS r_id, l.area AS l_area, r.area AS r_area, greatest(0, least(l.x2, r.x2) - greatest(l.x1, r.x1)) * greatest(0, least(l.y2, r.y2) - greatest(l.y1, r.y1)) AS inter,
 l.x1 <= r.x1 AND l.y1 <= r.y1 AND l.x2 >= r.x2 AND l.y2 >= r.y2 AS covers FROM a l JOIN a r ON l.label = r.label AND l.vec_id <> r.vec_id)"""
CELL = 0.25


def boxes(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", "label", e(0).alias("x1"), e(1).alias("y1"), (e(0) + F.abs(e(2)) + 0.05).alias("x2"), (e(1) + F.abs(e(3)) + 0.05).alias("y2"))


def pairs(spark, d):
    b = boxes(spark, d)
    p = joins.box_join(b, b, ["label"], CELL).filter(F.col("l_vec_id") != F.col("r_vec_id"))
    left, right = Box.of("l_"), Box.of("r_")
    return p.select(F.col("l_vec_id").alias("l_id"), F.col("r_vec_id").alias("r_id"), left.area.alias("l_area"), right.area.alias("r_area"), left.intersection(right).alias("inter"), left.contains(right).alias("covers"))


@query(f"WITH {SQL} SELECT label, count(*) AS n, round(min(x1), 6) AS x1, round(min(y1), 6) AS y1, round(max(x2), 6) AS x2, round(max(y2), 6) AS y2 FROM a GROUP BY label")
def union_bbox(spark, d):
    return boxes(spark, d).groupBy("label").agg(F.count("*").alias("n"), *(F.round(f(c), 6).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))))


@query(f"WITH {SQL} SELECT r_id AS vec_id, count(*) AS n_covering, round(max(inter / r_area), 6) AS best FROM m WHERE inter >= 0.55 * r_area GROUP BY r_id")
def box_overlap_join(spark, d):
    """Boxes that others cover by 55 % or more."""
    p = pairs(spark, d).filter(F.col("inter") >= 0.55 * F.col("r_area"))
    return p.groupBy(F.col("r_id").alias("vec_id")).agg(F.count("*").alias("n_covering"), F.round(F.max(F.col("inter") / F.col("r_area")), 6).alias("best"))


@query(f"WITH {SQL} SELECT vec_id, container FROM (SELECT r_id AS vec_id, l_id AS container, row_number() OVER (PARTITION BY r_id ORDER BY l_area, l_id) AS rn FROM m WHERE covers) WHERE rn = 1")
def smallest_container(spark, d):
    p = windows.first_wins(pairs(spark, d).filter("covers"), ["r_id"], ["l_area", "l_id"])
    return p.select(F.col("r_id").alias("vec_id"), F.col("l_id").alias("container"))


@query(f"WITH {SQL} SELECT l_id AS parent, r_id AS child FROM m WHERE l_area > r_area AND inter >= 0.85 * r_area")
def containment_edges(spark, d):
    return pairs(spark, d).filter((F.col("l_area") > F.col("r_area")) & (F.col("inter") >= 0.85 * F.col("r_area"))).select(F.col("l_id").alias("parent"), F.col("r_id").alias("child"))


@query(f"WITH {SQL} SELECT vec_id FROM a WHERE vec_id NOT IN (SELECT r_id FROM m WHERE inter >= 0.8 * r_area)")
def coverage_anti(spark, d):
    """Boxes that no other covers by 80 %."""
    return boxes(spark, d).select("vec_id").join(pairs(spark, d).filter(F.col("inter") >= 0.8 * F.col("r_area")).select(F.col("r_id").alias("vec_id")), "vec_id", "left_anti")


@query(f"WITH {SQL}, s AS (SELECT vec_id, x1, y1, x2, y2, least(1280 / 4.0, 720 / 3.0) AS k FROM a) SELECT vec_id, round(x1 * k + (1280 - 4.0 * k) / 2, 3) AS x1, round(y1 * k + (720 - 3.0 * k) / 2, 3) AS y1, greatest(1, round_even((x2 - x1) * k, 0))::BIGINT AS w FROM s")
def letterbox_transform(spark, d):
    """Boxes of a 4 by 3 page scaled into 1280 by 720, centred."""
    b = boxes(spark, d)
    t = letterbox(Box.of(""), (F.lit(4.0), F.lit(3.0)), (F.lit(1280.0), F.lit(720.0)))
    scale = min(1280 / 4.0, 720 / 3.0)
    return b.select("vec_id", F.round(t.x1, 3).alias("x1"), F.round(t.y1, 3).alias("y1"), F.greatest(F.lit(1).cast("long"), F.bround((F.col("x2") - F.col("x1")) * scale).cast("long")).alias("w"))


def paged(spark, d):
    """The boxes in pages of 200 ids of a label at most: what is folded in order of a page is bounded."""
    return boxes(spark, d).withColumn("page", F.col("label").cast("long") * 1_000_000_000 + F.floor(F.col("vec_id") / 200))


@query()
def greedy_nms(spark, d):
    return graph.greedy_nms(paged(spark, d), "page", "vec_id", 0.75)


@query()
def graph_colour(spark, d):
    return graph.graph_colour(paged(spark, d), "page", "vec_id")


@query()
def topo_order(spark, d):
    return graph.topo_order(paged(spark, d), "page", "vec_id")

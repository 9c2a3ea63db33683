"""Graphs: connected components as DataFrame steps, and order-dependent greedy operators as grouped maps."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from . import groups


#: Links from which on the least neighbours are written before they are joined, so that the join deals both sides anew and may split a hub.
HUB_LINKS = 1_000_000


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the least node reachable. Large-star and small-star steps until nothing
    changes; each step is written to the shared folder, so lineage stays short and lost executors cost a step."""
    name = f"cc-{uuid.uuid4().hex[:6]}"
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    alone = pairs.filter("u = v").select(F.col("u").alias("node"))
    e, known = stash(pairs.filter("u > v").distinct(), name), None
    written = (lambda x: stash(x, name)) if e.count() >= HUB_LINKS else (lambda x: x)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stash(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = stash(small.filter("u > v").distinct(), name)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == known:
            break
        known = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
    rest = alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(rest)


def components_within(edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """connected_components where no edge leaves its slide or page (keys): one pass in place of steps over all edges. Slides are bounded."""
    def step(rows: list[dict]) -> list[tuple]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for r in rows:
            p, q = root(r[a]), root(r[b])
            parent[max(p, q)] = min(p, q)
        return [(x, root(x)) for x in list(parent)]

    kind = edges.schema[a].dataType.simpleString()
    return groups.mapped(edges.select(*keys, a, b), keys, [], step, f"node {kind}, component {kind}")


def _grouped(df: DataFrame, key: str, order: list[str], step, out: str) -> DataFrame:
    """Fold each group in a stated order; the groups are pages or slides and so bounded. step: rows -> list of results."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        pdf[out] = step(pdf)
        return pdf

    return df.groupBy(key).applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} long")


def running_mean_rows(df: DataFrame, key: str, value: str, tie: str, tolerance: float) -> DataFrame:
    """Rows join the open cluster while within tolerance of its mean."""
    def step(pdf):
        out, cluster, total, n = [], -1, 0.0, 0
        for v in pdf[value]:
            if n == 0 or abs(v - total / n) > tolerance:
                cluster, total, n = cluster + 1, 0.0, 0
            total, n = total + v, n + 1
            out.append(cluster)
        return out

    return _grouped(df, key, [value, tie], step, "cluster")


def capped_union(df: DataFrame, key: str, value: str, tie: str, reach: float, ratio: float) -> DataFrame:
    """Union of neighbours within reach in order of value, refused where the cluster's largest would exceed ratio times its least, or that is not over 0."""
    def step(pdf):
        vals, parent = pdf[value].tolist(), list(range(len(pdf)))
        low, high = vals[:], vals[:]

        def root(i):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i in range(len(vals)):
            for j in range(i + 1, len(vals)):
                if vals[j] - vals[i] > reach:
                    break
                a, b = root(i), root(j)
                if a != b and min(low[a], low[b]) > 0 and max(high[a], high[b]) <= ratio * min(low[a], low[b]):
                    parent[b], low[a], high[a] = a, min(low[a], low[b]), max(high[a], high[b])
        ids: dict[int, int] = {}
        return [ids.setdefault(root(i), len(ids)) for i in range(len(vals))]

    return _grouped(df, key, [value, tie], step, "cluster")


def leader_cluster(df: DataFrame, key: str, value: str, tie: str, reach: float) -> DataFrame:
    """The first unassigned row leads; later rows within reach of the leader join."""
    def step(pdf):
        leaders, out = [], []
        for v in pdf[value]:
            k = next((i for i, x in enumerate(leaders) if abs(v - x) <= reach), None)
            if k is None:
                k = len(leaders)
                leaders.append(v)
            out.append(k)
        return out

    return _grouped(df, key, [tie], step, "cluster")


def _boxes(pdf):
    return list(zip(pdf.x1, pdf.y1, pdf.x2, pdf.y2))


def _meet(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def greedy_nms(df: DataFrame, key: str, tie: str, share: float) -> DataFrame:
    """Boxes by area, largest first; kept (1) unless one kept before meets it in share of the smaller area."""
    def step(pdf):
        boxes, kept = _boxes(pdf), []
        area = [(b[2] - b[0]) * (b[3] - b[1]) for b in boxes]
        out = [0] * len(boxes)
        for i in sorted(range(len(boxes)), key=lambda i: (-area[i], i)):
            if all(_meet(boxes[i], boxes[j]) < share * min(area[i], area[j]) for j in kept):
                kept.append(i)
                out[i] = 1
        return out

    return _grouped(df, key, [tie], step, "kept")


def graph_colour(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Colours for boxes so that boxes that meet differ: highest degree first, least free colour."""
    def step(pdf):
        boxes = _boxes(pdf)
        near = [[j for j in range(len(boxes)) if j != i and _meet(boxes[i], boxes[j]) > 0] for i in range(len(boxes))]
        out = [-1] * len(boxes)
        for i in sorted(range(len(boxes)), key=lambda i: (-len(near[i]), i)):
            used = {out[j] for j in near[i]}
            out[i] = next(c for c in range(len(boxes)) if c not in used)
        return out

    return _grouped(df, key, [tie], step, "colour")


def topo_order(df: DataFrame, key: str, tie: str, share: float = 0.85) -> DataFrame:
    """Drawing order: a box before those that lie in it by share; among the free ones the largest first, then y, x and tie."""
    import heapq

    def step(pdf):
        boxes = _boxes(pdf)
        area = [(b[2] - b[0]) * (b[3] - b[1]) for b in boxes]
        inside = [[j for j in range(len(boxes)) if area[i] > area[j] and _meet(boxes[i], boxes[j]) >= share * area[j]] for i in range(len(boxes))]
        wait = [0] * len(boxes)
        for x in inside:
            for j in x:
                wait[j] += 1
        rank = lambda i: (-area[i], boxes[i][1], boxes[i][0], i)
        heap, out = [(rank(i), i) for i in range(len(boxes)) if not wait[i]], [0] * len(boxes)
        heapq.heapify(heap)
        at = 0
        while heap:
            _, i = heapq.heappop(heap)
            out[i], at = at, at + 1
            for j in inside[i]:
                wait[j] -= 1
                if not wait[j]:
                    heapq.heappush(heap, (rank(j), j))
        return out

    return _grouped(df, key, [tie], step, "z")

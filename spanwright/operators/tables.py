"""Tables on a page: rows and columns of recognised text, candidates, cells from structure tokens, their text, boundaries and gates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import groups
from .joins import box_join

CELL = "row int, col int, rowspan int, colspan int"


def row_edges(items: DataFrame, keys: list[str], tie: str, gap: int = 4) -> DataFrame:
    """The items of a row that begin a cell: what starts within gap of the furthest end so far is part of the cell before."""
    w = Window.partitionBy(*keys).orderBy("x1", tie).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("__far", F.max("x2").over(w)).filter(F.col("__far").isNull() | (F.col("x1") >= F.col("__far") + gap)).drop("__far")


def column_centres(edges: DataFrame, keys: list[str], tolerance: int = 20) -> DataFrame:
    """(keys, col, centre, n): left edges a step of tolerance apart at most are one column, at their rounded mean."""
    w = Window.partitionBy(*keys).orderBy("x1")
    d = edges.withColumn("__new", F.when(F.col("x1") - F.lag("x1").over(w) > tolerance, 1).otherwise(0))
    d = d.withColumn("col", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "col").agg(F.bround(F.avg("x1")).cast("long").alias("centre"), F.count("*").alias("n"))


def _rows(items: list[dict]) -> list[list[dict]]:
    items = sorted(items, key=lambda r: (r["y1"] + r["y2"]) / 2)
    heights = [r["y2"] - r["y1"] for r in items if r["y2"] > r["y1"]]
    if not heights:
        return []
    tolerance, out, total = max(8.0, 0.6 * median(heights)), [], 0.0
    for r in items:
        y = (r["y1"] + r["y2"]) / 2
        if out and abs(y - total / len(out[-1])) <= tolerance:
            out[-1].append(r)
            total += y
        else:
            out.append([r])
            total = y
    return out


def _lefts(row: list[dict]) -> list[int]:
    out, far = [], None
    for r in sorted(row, key=lambda r: r["x1"]):
        if far is None or r["x1"] >= far + 4:
            out.append(r["x1"])
        far = r["x2"] if far is None else max(far, r["x2"])
    return out


def _variation(values: list[float]) -> float:
    mean = sum(values) / len(values) if values else 0
    return (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 / mean if mean > 0 else float("inf")


def candidates_of(items: list[dict], min_rows: int = 3, min_cols: int = 2, tolerance: int = 20, padding: int = 6, most_variation: float = 0.6, least_density: float = 0.6) -> list[dict]:
    """The tables of a page: runs of rows that share columns which enough rows have, with even columns and rows, and filled well enough."""
    rows = _rows(items)
    lefts = [_lefts(r) for r in rows]
    groups: list[list[int]] = []
    for x in sorted(x for row in lefts for x in row):
        if groups and x - groups[-1][-1] <= tolerance:
            groups[-1].append(x)
        else:
            groups.append([x])
    centres = [round(sum(g) / len(g)) for g in groups]
    hits = [{min(near)[1] for x in row if (near := [(abs(x - c), j) for j, c in enumerate(centres) if abs(x - c) <= tolerance])} for row in lefts]
    good = {j for j in range(len(centres)) if sum(j in h for h in hits) >= min_rows}
    hits = [h & good for h in hits]
    out, i = [], 0
    while i < len(rows):
        if len(hits[i]) < min_cols or len(good) < min_cols:
            i += 1
            continue
        seen, end = set(hits[i]), i + 1
        while end < len(rows) and len(hits[end] & seen) >= min_cols:  # against all columns that the run has had
            seen |= hits[end]
            end += 1
        cols = sorted(seen)
        cells = [r for row in rows[i:end] for r in row if any(abs(r["x1"] - centres[j]) <= tolerance for j in cols)]
        widths, heights = [centres[b] - centres[a] for a, b in zip(cols, cols[1:])], [max(r["y2"] - r["y1"] for r in row) for row in rows[i:end]]
        density = len(cells) / max(1, (end - i) * len(cols))
        if end - i >= min_rows and cells and widths and _variation(widths) <= most_variation and _variation(heights) <= most_variation and density >= least_density:
            out.append({"x1": max(0, min(r["x1"] for r in cells) - padding), "y1": max(0, min(r["y1"] for r in cells) - padding), "x2": max(r["x2"] for r in cells) + padding, "y2": max(r["y2"] for r in cells) + padding,
                        "rows": end - i, "cols": len(cols), "cells_used": len(cells), "density": round(density, 3)})
        i = end
    return out


def detect(items: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of every page. A page's rows are found by a running mean, which no window expresses, so a page is one group; pages are bounded."""
    own = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)

    def one(rows: list[dict]) -> list[tuple]:
        return [(*(rows[0][k] for k in keys), *c.values()) for c in candidates_of(rows)]

    return groups.mapped(items, keys, ["y1", "x1", "y2", "x2"], one, f"{own}, x1 long, y1 long, x2 long, y2 long, rows int, cols int, cells_used int, density double")


def cells_of(tokens: list[str]) -> list[tuple[int, int, int, int]]:
    """(row, col, rowspan, colspan) of each cell in the order of its token: the leftmost column that no span above takes."""
    out, taken, row, k = [], set(), -1, 0
    while k < len(tokens):
        t = tokens[k]
        k += 1
        if t == "<tr>":
            row += 1
        if not t.startswith("<td"):
            continue
        attrs = ""
        if t == "<td":
            while k < len(tokens) and tokens[k] != ">":
                attrs += tokens[k]
                k += 1
        if t != "<td></td>":
            while k < len(tokens) and tokens[k] != "</td>":
                k += 1
            k += 1
        row = max(row, 0)
        span = [int(m[1]) if (m := re.search(rf'{name}="?(\d+)"?', attrs)) else 1 for name in ("rowspan", "colspan")]
        col = next(c for c in range(len(taken) + 1) if (row, c) not in taken)
        taken |= {(row + i, col + j) for i in range(span[0]) for j in range(span[1])}
        out.append((row, col, *span))
    return out


def structure_cells(tables: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, cell, row, col, rowspan, colspan) from structure tokens."""
    kind = tables.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, i, *c) for k, t in zip(pdf[key], pdf[tokens]) for i, c in enumerate(cells_of(list(t) if t is not None else []))], columns=[key, "cell", "row", "col", "rowspan", "colspan"])

    return tables.select(key, tokens).mapInPandas(run, f"{key} {kind}, cell int, {CELL}")


def _centred(items: DataFrame, cells: DataFrame, keys: list[str], whole: bool, cell: float) -> DataFrame:
    """Pairs of an item and a cell that holds its centre; whole: centres in whole numbers."""
    c = items.select(*keys, "id", *(x for x in ("text", "y1", "x1") if x in items.columns), "x2", "y2")
    mid = lambda a, b: F.floor((F.col(f"a_{a}") + F.col(f"a_{b}")) / 2) if whole else (F.col(f"a_{a}") + F.col(f"a_{b}")) / 2
    d = box_join(c, cells.select(*keys, "cell", "x1", "y1", "x2", "y2"), keys, cell, "a_", "b_").drop(*(f"b_{k}" for k in keys)).withColumnsRenamed({f"a_{k}": k for k in keys})
    return d.filter(mid("x1", "x2").between(F.col("b_x1"), F.col("b_x2")) & mid("y1", "y2").between(F.col("b_y1"), F.col("b_y2")))


def cell_texts(items: DataFrame, cells: DataFrame, keys: list[str], cell: float = 300) -> DataFrame:
    """(keys, cell, text): the texts whose centre lies in a cell, in reading order; a cell without any has none."""
    d = _centred(items, cells, keys, True, cell)
    got = d.groupBy(*keys, F.col("b_cell").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("a_y1", "a_x1", "a_id", "a_text"))).alias("x"))
    return cells.select(*keys, "cell").join(got, [*keys, "cell"], "left").select(*keys, "cell", F.coalesce(F.trim(F.array_join(F.transform("x", lambda r: r["a_text"]), " ")), F.lit("")).alias("text"))


def outside(items: DataFrame, cells: DataFrame, keys: list[str], cell: float = 300) -> DataFrame:
    """The items that no cell takes."""
    return items.join(_centred(items, cells, keys, False, cell).select(*keys, F.col("a_id").alias("id")).distinct(), [*keys, "id"], "left_anti")


def boundaries(samples: DataFrame, keys: list[str], low: str, high: str, count: str) -> DataFrame:
    """(keys, edges): of a table's count columns (or rows) the count + 1 boundaries. samples: at and value, beside the bounds. Each is the upper median of its
    samples, or in proportion without any; the ends are the bounds; each is 5 beyond the one before at least."""
    g = samples.groupBy(*keys, low, high, count, "at").agg(F.sort_array(F.collect_list("value")).alias("v")).withColumn("mid", F.get("v", F.floor(F.size("v") / 2).cast("int")))
    g = g.groupBy(*keys, low, high, count).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("long"), F.col("mid").cast("long")))).alias("m"))
    lo, hi, n = F.col(low).cast("long"), F.col(high).cast("long"), F.col(count).cast("long")
    raw = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.when(i == 0, lo).when(i == n, hi).otherwise(F.coalesce(F.element_at("m", i), F.bround(lo + (hi - lo) * i / F.greatest(F.lit(1), n)).cast("long"))))
    far = lambda a: F.element_at(a, -1)
    grown = F.aggregate(F.slice(raw, F.lit(2), F.size(raw)), F.slice(raw, F.lit(1), F.lit(1)), lambda a, x: F.concat(a, F.array(F.when(x <= far(a) + 4, far(a) + 5).otherwise(x))))
    return g.select(*keys, F.concat(F.slice(grown, F.lit(1), F.size(grown) - 1), F.array(hi)).alias("edges"))


def accepted(score: Column, rows: Column, cols: Column, covered: Column, x1: Column, y1: Column, x2: Column, y2: Column, least: float) -> Column:
    """A recognised table that is one: a real score at the threshold, two rows and columns, half its grid filled, a box."""
    s = F.coalesce(score, F.lit(0.0))
    return ~F.isnan(s) & (s != float("inf")) & (s >= least) & (rows >= 2) & (cols >= 2) & (covered / (rows * cols) >= 0.5) & (x2 > x1) & (y2 > y1)

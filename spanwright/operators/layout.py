"""Operators on slides: texts in containers, slots of one style, connectors and outlines, order, and elements from recognised text.

Boxes are columns x1, y1, x2, y2; texts have id, text, size, bold, align and color (#RRGGBB), containers cid and a name. keys name the
columns of a slide. Pairs of boxes come from a grid join, and pairs of texts from containers that they share or that are
siblings, so no step pairs all texts of a slide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.colour import Colour, reach
from ..functions.geometry import Box
from ..session import stash
from .joins import box_join

#: Sizes of one style differ by this at most.
SIZE_DELTA = 2.0


def _area(b: Box) -> Column:
    return F.greatest(F.lit(0), b.x2 - b.x1) * F.greatest(F.lit(0), b.y2 - b.y1)


def _met(boxes: DataFrame, others: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pairs that touch: columns a_ and b_, the keys of a once, and inter."""
    d = box_join(boxes, others, keys, cell, "a_", "b_").drop(*(f"b_{k}" for k in keys)).withColumnsRenamed({f"a_{k}": k for k in keys})
    return d.withColumn("inter", Box.of("a_").intersection(Box.of("b_")))


def members(texts: DataFrame, containers: DataFrame, keys: list[str], cell: float = 300) -> DataFrame:
    """(keys, id, cid, area, texts_in, direct): each text in each container that holds its centre, give or take 6, and 55 % of its area. texts_in counts a
    container's texts; direct marks a text's smallest container, the first of equals."""
    t, c = Box.of("a_"), Box.of("b_")
    d = _met(texts.select(*keys, "id", "x1", "y1", "x2", "y2"), containers.select(*keys, "cid", "x1", "y1", "x2", "y2"), keys, cell)
    cx, cy = (t.x1 + t.x2) / 2, (t.y1 + t.y2) / 2
    inside = cx.between(c.x1 - 6, c.x2 + 6) & cy.between(c.y1 - 6, c.y2 + 6)
    d = d.filter(inside & (F.col("inter") / F.greatest(F.lit(1), _area(t)) >= 0.55)).select(*keys, F.col("a_id").alias("id"), F.col("b_cid").alias("cid"), _area(c).alias("area"))
    d = d.withColumn("texts_in", F.count("*").over(Window.partitionBy(*keys, "cid")))
    return d.withColumn("direct", F.row_number().over(Window.partitionBy(*keys, "id").orderBy("area", "cid")) == 1)


def siblings(containers: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of containers, both ways, of like size whose centres share a row or a column. Sizes within 18 % share a bucket of their logarithm or adjoining ones,
    so the pairs come from an equi join."""
    c = containers.select(*keys, "cid", "x1", "y1", "x2", "y2").filter("x2 > x1 and y2 > y1").withColumn("step", F.floor(F.log(F.col("x2") - F.col("x1")) / F.log(F.lit(1.18))))
    a = c.select(*keys, *(F.col(x).alias(f"a_{x}") for x in ("cid", "x1", "y1", "x2", "y2", "step")))
    b = c.select(*(F.col(k).alias(f"b_{k}") for k in keys), *(F.col(x).alias(f"b_{x}") for x in ("cid", "x1", "y1", "x2", "y2")), F.explode(F.array(*(F.col("step") + i for i in (-1, 0, 1)))).alias("b_step"))
    on = (F.col("a_step") == F.col("b_step")) & (F.col("a_cid") != F.col("b_cid"))
    for k in keys:
        on &= F.col(k) == F.col(f"b_{k}")
    p, q = Box.of("a_"), Box.of("b_")
    aw, ah, bw, bh = p.x2 - p.x1, p.y2 - p.y1, q.x2 - q.x1, q.y2 - q.y1
    like = (F.greatest(aw, bw) / F.least(aw, bw) <= 1.18) & (F.greatest(ah, bh) / F.least(ah, bh) <= 1.22)
    row = F.abs((p.y1 + p.y2) / 2 - (q.y1 + q.y2) / 2) <= F.greatest(F.lit(12.0), F.least(ah, bh) * 0.18)
    col = F.abs((p.x1 + p.x2) / 2 - (q.x1 + q.x2) / 2) <= F.greatest(F.lit(12.0), F.least(aw, bw) * 0.18)
    return a.join(b, on).filter(like & (row | col)).drop(*(f"b_{k}" for k in keys), "a_step", "b_step")


#: What a text's colour and words say, worked out once a text and not once a pair.
_LOOKS = ("r", "g", "b", "family", "visible", "label")


def _looks(texts: DataFrame) -> DataFrame:
    c = Colour.parse(F.col("color"))
    return texts.withColumns({"r": c.r, "g": c.g, "b": c.b, "family": c.family, "visible": tx.visible_length(F.col("text")), "label": tx.compact_label(F.col("text"))})


#: What is asked of two texts whatever holds them.
_ALIKE = ("compact", "alert", "listed", "row", "column")


def _alike(d: DataFrame, keys: list[str], *held: Column) -> DataFrame:
    """Pairs of texts (a_ and b_, with looks) of one style or of compact titles, with what holds them: most pairs end here, before they are dealt anew."""
    a, b = Box.of("a_"), Box.of("b_")
    ca, cb = (Colour(*(F.col(f"{side}_{c}") for c in "rgb")) for side in "ab")
    family = F.col("a_family")
    one_family = family == F.col("b_family")
    near = one_family & (ca.distance(cb) <= reach(family))
    sizes, align = [F.col(f"{s}_size").cast("double") for s in "ab"], F.col("a_align") == F.col("b_align")
    ratio = F.greatest(*sizes) / F.greatest(F.lit(1.0), F.least(*sizes))
    delta = F.abs(sizes[0] - sizes[1])
    style = align & (F.least(*sizes) > 0) & (delta <= SIZE_DELTA) & (ratio <= 1.75) & near
    bold, unmarked = F.col("a_bold") & F.col("b_bold"), ~F.col("a_marker") & ~F.col("b_marker")
    blue = one_family & (family == "blue")
    compact = (~style & align & blue & near & bold & unmarked & F.col("a_label") & F.col("b_label") & (F.least(*sizes) >= 20) & (delta > SIZE_DELTA) & (ratio <= 1.45) & (delta <= 14.0))
    va, vb = F.col("a_visible"), F.col("b_visible")
    alert = one_family & (family == "red") & bold & unmarked & (F.least(va, vb) >= 6)
    ah, bh = F.greatest(F.lit(1.0), a.y2 - a.y1), F.greatest(F.lit(1.0), b.y2 - b.y1)
    gap = F.when(a.y1 <= b.y1, b.y1 - a.y2).otherwise(a.y1 - b.y2)
    listed = (F.col("a_align") == "left") & align & blue & bold & unmarked & (F.least(va, vb) >= 2) & (F.greatest(va, vb) <= 48)
    listed = listed & (gap >= -0.12 * F.least(ah, bh)) & (gap <= F.greatest(F.lit(86.0), (ah + bh) / 2 * 1.85)) & (F.abs(a.x1 - b.x1) <= 26.0)
    row = F.abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= F.greatest(F.lit(4.0), F.least(a.y2 - a.y1, b.y2 - b.y1) * 0.42)
    narrow = F.least(a.x2 - a.x1, b.x2 - b.x1)
    column = (F.greatest(F.lit(0.0), F.greatest(a.y1, b.y1) - F.least(a.y2, b.y2)) <= 42.0) & ((F.abs(a.x1 - b.x1) <= F.greatest(F.lit(7.0), F.least(F.lit(18.0), narrow * 0.14))) | (F.abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) <= 10.0))
    return d.filter(style | compact).select(*keys, "a_id", "b_id", *held, compact.alias("compact"), alert.alias("alert"), listed.alias("listed"), row.alias("row"), column.alias("column"))


def style_edges(texts: DataFrame, containers: DataFrame, keys: list[str], cell: float = 300) -> DataFrame:
    """(keys, a_id, b_id, reasons): pairs of texts of one style, or of compact titles, that share a container of three texts or more, their smallest one, or a
    place in sibling containers, and that stand in one row, column, slot, alert band or list."""
    if "marker" not in texts.columns:
        texts = texts.withColumn("marker", F.lit(False))
    seen = (*_LOOKS, "x1", "y1", "x2", "y2", "size", "bold", "align", "marker")
    m = members(texts, containers, keys, cell).join(_looks(texts).select(*keys, "id", *seen), [*keys, "id"]).join(containers.select(*keys, "cid", "name"), [*keys, "cid"])
    m = stash(m, "members")  # four joins read it
    side = lambda s, *more: m.select(*keys, *more, *(F.col(c).alias(f"{s}_{c}") for c in ("id", "direct", *seen)))
    scope = F.when(F.col("texts_in") >= 3, F.struct("area", "cid", "name"))
    no = F.lit(False)
    shared = side("a", "cid", "area", "texts_in", "name").join(side("b", "cid"), [*keys, "cid"]).filter("a_id < b_id")
    shared = _alike(shared, keys, scope.alias("scope"), (F.col("a_direct") & F.col("b_direct")).alias("same_parent"), no.alias("near"), no.alias("slot"), no.alias("band"))

    pairs = siblings(containers, keys).withColumnsRenamed({f"{s}_{c}": f"{s}_c{c}" for s in "ab" for c in ("x1", "y1", "x2", "y2")})
    pairs = pairs.join(side("a", F.col("cid").alias("a_cid")), [*keys, "a_cid"]).join(side("b", F.col("cid").alias("b_cid")), [*keys, "b_cid"]).filter("a_id < b_id")

    def rel(s: str) -> list[Column]:
        t, c = Box.of(f"{s}_"), Box.of(f"{s}_c")
        w, h = F.greatest(F.lit(1.0), c.x2 - c.x1), F.greatest(F.lit(1.0), c.y2 - c.y1)
        return [(t.x1 - c.x1) / w, (t.y1 - c.y1) / h, (t.x2 - t.x1) / w, (t.y2 - t.y1) / h]

    p, q = rel("a"), rel("b")
    off = [F.abs(i - j) for i, j in zip(p, q)]
    slot = (off[0] <= 0.08) & (off[1] <= 0.10) & (off[2] <= 0.22) & (off[3] <= 0.16)
    band = (F.least(p[1], q[1]) >= 0.45) & (off[0] <= 0.12) & (off[1] <= 0.12) & (off[3] <= 0.12)
    apart = _alike(pairs, keys, F.lit(None).cast(shared.schema["scope"].dataType).alias("scope"), no.alias("same_parent"), F.lit(True).alias("near"), slot.alias("slot"), band.alias("band"))
    d = shared.unionByName(apart).groupBy(*keys, "a_id", "b_id").agg(F.min("scope").alias("scope"), *(F.max(c).alias(c) for c in ("same_parent", "near", "slot", "band", *_ALIKE)))
    has_scope = F.col("scope").isNotNull()
    alert = F.col("band") & F.col("alert")
    listed = F.col("listed") & (F.col("same_parent") | has_scope | F.col("near"))
    why = F.array_compact(F.array(F.when(F.col("row"), "row"), F.when(F.col("column"), "column"), F.when(F.col("slot"), "relative_slot"), F.when(alert, "relative_alert_band"), F.when(listed, "vertical_list_slot"), F.when(F.col("compact"), "compact_latin_title")))
    d = d.filter(has_scope | F.col("slot") | alert | listed | F.col("same_parent")).withColumn("why", why).filter(F.size("why") > 0)
    more = F.array_compact(F.array(F.concat(F.lit("scope:"), F.col("scope")["name"]), F.when(F.col("same_parent"), "same_parent")))
    return d.select(*keys, "a_id", "b_id", F.concat("why", more).alias("reasons"))


def half_up_median(c: str) -> Column:
    return F.floor(F.percentile(c, F.lit(0.5)) + 0.5)


def dominant(c: str) -> Column:
    """Of values counted in column c as arrays: the most frequent, the least of equals."""
    return F.array_min(F.transform(F.array_distinct(c), lambda v: F.struct((-F.size(F.filter(c, lambda x: x == v))).alias("n"), v.alias("v"))))["v"]


def style_classes(texts: DataFrame, classes: DataFrame, keys: list[str], least: int = 2, edges: DataFrame | None = None) -> DataFrame:
    """A row for each class of texts. classes: (id, component). With sizes further apart than a style allows a class stands only if it is one of compact titles
    (edges given) and has no suggested size. Ordered by place: class_id by its uppermost, then leftmost text."""
    d = texts.join(classes, "id")
    g = d.groupBy(*keys, "component").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("size")).alias("sizes"), half_up_median("size").alias("median"), F.collect_list("align").alias("aligns"), F.collect_list("bold").alias("bolds"),
                                         F.min_by("color", "id").alias("color"), F.min("y1").alias("y1"), F.min("x1").alias("x1"))
    delta = F.round(F.array_max("sizes") - F.array_min("sizes"), 3)
    g = g.filter(F.col("count") >= least).withColumns({"size_delta": delta, "eligible": delta <= SIZE_DELTA, "align": dominant("aligns"), "bold": dominant("bolds")})
    if edges is None:
        g = g.filter("eligible")
    else:
        titles = edges.filter(F.array_contains("reasons", "compact_latin_title")).select(F.col("a_id").alias("id")).join(classes, "id").select("component").distinct()
        g = g.join(titles.withColumn("titles", F.lit(True)), "component", "left").filter(F.col("eligible") | F.col("titles")).drop("titles")
    stable = F.size(F.filter("bolds", lambda x: x == F.col("bold"))) >= F.greatest(F.lit(3), F.col("count") - 1)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("y1", "x1", "component"))
    return g.select(*keys, F.format_string("slot_%02d", at).alias("class_id"), "component", "count", F.when(F.col("eligible"), F.col("median")).alias("suggested_size"), "size_delta", F.col("eligible").alias("size_unification_eligible"), "align", "bold",
                    stable.alias("bold_stable"), Colour.parse(F.col("color")).family.alias("colour_family"))


def border_connector(container: Box, connector: Box) -> Column:
    """The connector is a dash of the container's own border: 80 % in it, along an edge or at a corner."""
    one = F.lit(1)
    pw, ph, cw, ch = (F.greatest(one, x) for x in (container.x2 - container.x1, container.y2 - container.y1, connector.x2 - connector.x1, connector.y2 - connector.y1))
    area = F.greatest(one, (connector.x2 - connector.x1) * (connector.y2 - connector.y1))
    band = F.greatest(F.lit(4), F.least(F.lit(14), F.bround(F.least(pw, ph) * 0.22).cast("int")))
    ends = ((connector.y1 - container.y1 <= band) | (container.y2 - connector.y2 <= band), (connector.x1 - container.x1 <= band) | (container.x2 - connector.x2 <= band))
    flat, tall = cw >= F.greatest(F.lit(12.0), ch * 2.0), ch >= F.greatest(F.lit(12.0), cw * 2.0)
    return (container.intersection(connector) >= 0.80 * area) & ((flat & ends[0]) | (tall & ends[1]) | (ends[0] & ends[1]))


def without_border_connectors(connectors: DataFrame, containers: DataFrame, keys: list[str], cell: float = 300) -> DataFrame:
    """Connectors that are no part of a container's border. connectors: id and box."""
    d = _met(containers.select(*keys, "cid", "x1", "y1", "x2", "y2"), connectors.select(*keys, "id", "x1", "y1", "x2", "y2"), keys, cell)
    part = d.filter(border_connector(Box.of("a_"), Box.of("b_"))).select(*keys, F.col("b_id").alias("id")).distinct()
    return connectors.join(part, [*keys, "id"], "left_anti")


#: Roles that are children by name, and those that are no asset with children.
CHILD_ROLES = ["subicon", "badge_subicon", "line_subicon", "internal", "connector"]
NO_PARENTS = ["outline", "background", "internal", "subicon", "badge_subicon", "connector", "line_subicon"]


def children(assets: DataFrame, keys: list[str], cell: float = 300) -> DataFrame:
    """(keys, parent, child): assets of under 55 % of a parent's area that lie in it by 85 % and are children by role or by size, connectors on its border excepted.
    assets: id, role and box."""
    d = _met(assets.select(*keys, "id", "role", "x1", "y1", "x2", "y2"), assets.select(*keys, "id", "role", "x1", "y1", "x2", "y2"), keys, cell).filter("a_id <> b_id")
    p, c = Box.of("a_"), Box.of("b_")
    one = F.lit(1)
    pa, ca = F.greatest(one, (p.x2 - p.x1) * (p.y2 - p.y1)), F.greatest(one, (c.x2 - c.x1) * (c.y2 - c.y1))
    cw, ch = c.x2 - c.x1, c.y2 - c.y1
    small = (ca <= 18000) & (F.greatest(cw, ch) <= 180)
    flat = (ca <= 30000) & (F.least(cw, ch) <= 90) & (cw <= 0.95 * F.greatest(one, p.x2 - p.x1)) & (ch <= 0.80 * F.greatest(one, p.y2 - p.y1))
    border = (F.col("a_role") == "container") & (F.col("b_role") == "connector") & border_connector(p, c)
    ok = ~F.col("b_role").isin("background", "outline") & (ca < pa * 0.55) & ~border & (F.col("b_role").isin(CHILD_ROLES) | small | flat) & (F.col("inter") >= 0.85 * ca) & (F.col("inter") > 0)
    return d.filter(ok).select(*keys, F.col("a_id").alias("parent"), F.col("b_id").alias("child"))


def redundant_outlines(outlines: DataFrame, keys: list[str], cell: float = 300) -> DataFrame:
    """Outlines that wrap two others side by side, which are cards of their own. outlines: id and box."""
    o = outlines.select(*keys, "id", "x1", "y1", "x2", "y2")
    d = _met(o, o, keys, cell).filter("a_id <> b_id")
    a, b = Box.of("a_"), Box.of("b_")
    one = F.lit(1)
    area = lambda x: F.greatest(one, (x.x2 - x.x1) * (x.y2 - x.y1))
    held = d.filter((area(b) < 0.85 * area(a)) & (F.col("inter") > 0) & (F.col("inter") >= 0.72 * area(b))).select(*keys, F.col("a_id").alias("id"), *(F.col(f"b_{c}").alias(c) for c in ("id", "x1", "y1", "x2", "y2") if c != "id"), F.col("b_id").alias("in_id"))
    p = held.select(*keys, "id", *(F.col(c).alias(f"p_{c}") for c in ("in_id", "x1", "y1", "x2", "y2")))
    q = held.select(*keys, "id", *(F.col(c).alias(f"q_{c}") for c in ("in_id", "x1", "y1", "x2", "y2")))
    x, y = Box.of("p_"), Box.of("q_")
    over = lambda low, high: F.greatest(F.lit(0), F.least(*high) - F.greatest(*low))
    side = (over((x.y1, y.y1), (x.y2, y.y2)) >= 0.70 * F.least(x.y2 - x.y1, y.y2 - y.y1)) & (over((x.x1, y.x1), (x.x2, y.x2)) <= 0.20 * F.least(x.x2 - x.x1, y.x2 - y.x1))
    wraps = p.join(q, [*keys, "id"]).filter((F.col("p_in_id") < F.col("q_in_id")) & side).select(*keys, "id").distinct()
    return outlines.join(wraps, [*keys, "id"], "left_semi")


def carried_outlines(outlines: DataFrame, assets: DataFrame, keys: list[str], page_area: float, cell: float = 300) -> DataFrame:
    """Outlines that a larger asset, no page background, already shows: 92 % in an asset of 2.8 times the area."""
    d = _met(outlines.select(*keys, "id", "x1", "y1", "x2", "y2"), assets.select(*keys, "id", "role", "x1", "y1", "x2", "y2"), keys, cell)
    a, b = Box.of("a_"), Box.of("b_")
    one = F.lit(1)
    oa, pa = F.greatest(one, (a.x2 - a.x1) * (a.y2 - a.y1)), F.greatest(one, (b.x2 - b.x1) * (b.y2 - b.y1))
    ok = ~F.coalesce(F.col("b_role").isin(NO_PARENTS), F.lit(False)) & (pa <= 0.85 * page_area) & (pa >= 2.8 * oa) & (F.col("inter") >= 0.92 * oa)
    return outlines.join(d.filter(ok).select(*keys, F.col("a_id").alias("id")).distinct(), [*keys, "id"], "left_semi")


def centred_titles(texts: DataFrame, images: DataFrame, keys: list[str], share: float = 0.05, most: float = 25, longest: int = 8, cell: float = 300) -> DataFrame:
    """(keys, id, new_x1): short texts whose centre is near that of the smallest image strictly around them, and where they start when centred in it."""
    short = texts.filter(F.length("text") <= longest)
    d = _met(short.select(*keys, "id", "x1", "y1", "x2", "y2"), images.select(*keys, "cid", "x1", "y1", "x2", "y2").filter("x2 > x1 and y2 > y1"), keys, cell)
    t, i = Box.of("a_"), Box.of("b_")
    d = d.filter((i.x1 < t.x1) & (i.y1 < t.y1) & (i.x2 > t.x2) & (i.y2 > t.y2))
    least = F.row_number().over(Window.partitionBy(*keys, "a_id").orderBy(_area(i), "b_cid"))
    d = d.withColumn("rn", least).filter("rn = 1")
    mid = (i.x1 + i.x2) / 2
    near = F.abs((t.x1 + t.x2) / 2 - mid) <= F.least(share * (i.x2 - i.x1), F.lit(float(most)))
    return d.filter(near).select(*keys, F.col("a_id").alias("id"), F.bround(mid - (t.x2 - t.x1) / 2).cast("long").alias("new_x1"))


def text_elements(items: DataFrame, keys: list[str], order: list, page_h: Column, slide_h_in: float = 7.5) -> DataFrame:
    """Recognised text as text elements: blank text and empty boxes are left out, names run t000, t001 in order, the size follows the box's height."""
    ok = items.filter((F.trim("text") != "") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    factor = F.when(tx.cjk_dominant(F.col("text"), tx.CJK_BROAD), 0.85).otherwise(0.78)
    size = F.greatest(F.lit(6), F.least(F.lit(96), F.bround((F.col("y2") - F.col("y1")) * (F.lit(slide_h_in * 72.0) / F.greatest(F.lit(1), page_h)) * factor))).cast("long")
    name = F.format_string("t%03d", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return ok.select(*keys, name.alias("name"), F.lit("text").alias("type"), F.trim("text").alias("text"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), size.alias("size"),
                     F.lit("Microsoft YaHei").alias("font"), F.lit(False).alias("bold"), F.lit("#111111").alias("color"), F.lit("left").alias("align"))


#: Drawing order of images by role; others are 1.
ROLE_ORDER = {"background": 0, "container": 1, "outline": 2, "internal": 3, "badge_subicon": 4, "connector": 4, "line_subicon": 4, "subicon": 4}


def drawing_order(kind: Column, role: Column, y: Column, x: Column) -> list[Column]:
    """Sort columns: images before texts, by role, then from top to bottom."""
    rank = F.lit(1)
    for name, k in ROLE_ORDER.items():
        rank = F.when(role == name, k).otherwise(rank)
    image = kind == "image"
    return [F.when(image, 0).otherwise(1), F.when(image, rank).otherwise(0), y, x]


def marker_owner(name: Column) -> Column:
    """The text that a list marker's name says it belongs to, or null."""
    end = F.regexp_extract(name, "^(.*)_bullet_marker(?:_inferred)?$", 1)
    middle = F.regexp_extract(name, "^(.*?)_bullet_marker_", 1)
    return F.coalesce(F.nullif(end, F.lit("")), F.nullif(middle, F.lit("")))


def marker_penalty(w: Column, h: Column) -> Column:
    """How unlike a list marker a box is: off square, or of odd height."""
    w, h = F.greatest(F.lit(1.0), w), F.greatest(F.lit(1.0), h)
    return F.abs(F.log(F.greatest(F.lit(0.1), F.least(F.lit(10.0), w / h)))) + F.greatest(F.lit(0.0), h - 16.0) * 0.25 + F.greatest(F.lit(0.0), 5.0 - h)


def icon_prefix(items: DataFrame) -> DataFrame:
    """Items whose first four characters hold a bar: what is before it is an icon, so the text and the box start after it."""
    t = F.col("text")
    rest = F.regexp_replace(F.regexp_extract(t, r"(?s)^[^|丨]{0,3}[|丨](.*)$", 1), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    wide = F.greatest(F.col("y2") - F.col("y1"), F.lit(25))
    ok = (F.length(t) >= 2) & t.rlike(r"(?s)^[^|丨]{0,3}[|丨]") & rest.rlike(r"[\p{L}\p{N}]") & (F.col("x1") + wide + 10 < F.col("x2"))
    return items.withColumns({"text": F.when(ok, rest).otherwise(t), "x1": F.when(ok, F.col("x1") + wide + 4).otherwise(F.col("x1"))})

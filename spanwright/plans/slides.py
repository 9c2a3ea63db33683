"""Queries on slides: 24 lines of a document each, with boxes, sizes, colours and confidences made from ids and places by arithmetic, and six containers
a slide. They are no real slides; they apply the operators on recognised text and layouts to whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.colour import Colour, spread_hue
from ..functions.geometry import Box
from ..operators import folds, graph, layout, rules, windows
from ..session import stash
from .registry import query
from .text import LINES, lines

W, H = 1280, 720
KEYS = ["doc_id", "slide"]
COLOURS = ["#054798", "#D43E3E", "#222222", "#7A8191", "#1050A0"]
ROLES = ["container", "outline", "subicon", "card", "connector", "container"]

ITEMS = LINES + f""", items AS (SELECT *, x1 + w AS x2, y1 + h AS y2 FROM (SELECT doc_id, idx // 24 AS slide, doc_id * 1048576 + idx AS id, idx, line AS text, ((doc_id * 31 + idx * 17) % 101) / 100::DOUBLE AS confidence,
 40 + (idx % 4) * 300 + (doc_id + idx) % 5 AS x1, 30 + ((idx % 24) // 12) * 330 + ((idx // 4) % 3) * 34 + (doc_id + 3 * idx) % 7 AS y1, 20 + least(length(line), 30) * 8 AS w, 14 + (doc_id * 5 + idx) % 17 AS h,
 10 + (doc_id * 3 + idx // 4) % 5 AS size, (doc_id + idx // 4) % 7 <> 0 AS bold, {COLOURS}[(doc_id + idx // 12) % 5 + 1] AS color, CASE WHEN (doc_id + idx) % 4 = 0 THEN 'center' ELSE 'left' END AS align FROM lines WHERE line <> '')),
containers AS (SELECT doc_id, slide, k AS cid, 'box_' || k AS name, {ROLES}[k + 1] AS role, x1, y1, x1 + CASE WHEN k < 4 THEN 285 ELSE 585 END + (doc_id + k) % 3 AS x2, y1 + 330 AS y2 FROM
 (SELECT doc_id, slide, k, CASE WHEN k < 4 THEN 30 + k * 300 ELSE 30 + (k - 4) * 600 END + (doc_id + k) % 4 AS x1, CASE WHEN k < 4 THEN 20 ELSE 360 END AS y1 FROM (SELECT DISTINCT doc_id, slide FROM items) CROSS JOIN (SELECT unnest(range(0, 6)) AS k)))"""
#: SQL of the numbers of a colour.
RGB = "('0x' || substr(color, 2, 2))::BIGINT AS r, ('0x' || substr(color, 4, 2))::BIGINT AS g, ('0x' || substr(color, 6, 2))::BIGINT AS b"
FAMILY = "CASE WHEN least(r, g, b) >= 225 THEN 'white' WHEN greatest(r, g, b) <= 70 THEN 'black' WHEN r > g + 35 AND r > b + 35 THEN 'red' WHEN b > r + 32 AND b > g + 18 THEN 'blue' WHEN greatest(r, g, b) - least(r, g, b) <= 42 THEN 'gray' ELSE 'other' END"
MEET = "greatest(0, least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1)) * greatest(0, least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1))"


def _pick(values: list[str], at):
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


def items(spark, d):
    i, at = F.col("doc_id"), F.col("idx")
    x = lines(spark, d).filter("line <> ''").withColumn("idx", at.cast("long"))
    x = x.select("doc_id", F.floor(at / 24).alias("slide"), (i * 1048576 + at).alias("id"), "idx", F.col("line").alias("text"), (F.pmod(i * 31 + at * 17, F.lit(101)) / 100.0).alias("confidence"),
                 (40 + F.pmod(at, F.lit(4)) * 300 + F.pmod(i + at, F.lit(5))).alias("x1"), (30 + F.floor(F.pmod(at, F.lit(24)) / 12) * 330 + F.pmod(F.floor(at / 4), F.lit(3)) * 34 + F.pmod(i + 3 * at, F.lit(7))).alias("y1"),
                 (20 + F.least(F.length("line"), F.lit(30)).cast("long") * 8).alias("w"), (14 + F.pmod(i * 5 + at, F.lit(17))).alias("h"), (10 + F.pmod(i * 3 + F.floor(at / 4), F.lit(5))).alias("size"),
                 (F.pmod(i + F.floor(at / 4), F.lit(7)) != 0).alias("bold"), _pick(COLOURS, F.pmod(i + F.floor(at / 12), F.lit(5))).alias("color"), F.when(F.pmod(i + at, F.lit(4)) == 0, "center").otherwise("left").alias("align"))
    return x.withColumns({"x2": F.col("x1") + F.col("w"), "y2": F.col("y1") + F.col("h")})


def containers(spark, d, texts=None):
    """Six containers of each slide; texts: the slides' lines where they are at hand."""
    k, i = F.col("cid"), F.col("doc_id")
    s = (items(spark, d) if texts is None else texts).select(*KEYS).distinct().withColumn("cid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    x1 = F.when(k < 4, 30 + k * 300).otherwise(30 + (k - 4) * 600) + F.pmod(i + k, F.lit(4))
    s = s.withColumns({"name": F.concat(F.lit("box_"), k.cast("string")), "role": _pick(ROLES, k), "x1": x1, "y1": F.when(k < 4, 20).otherwise(360).cast("long")})
    return s.withColumns({"x2": F.col("x1") + F.when(k < 4, 285).otherwise(585) + F.pmod(i + k, F.lit(3)), "y2": F.col("y1") + 330})


# reviews -----------------------------------------------------------------------------------
@query(f"""WITH {ITEMS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide ORDER BY y1, x1, idx) - 1 AS n FROM items) SELECT doc_id, slide, 't' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS name, 'text' AS type, text, x1 AS x, y1 AS y, w, h,
 greatest(6, least(96, round_even(h * (540.0::DOUBLE / 720) * CASE WHEN 2 * length(regexp_replace(text, '[^\\x{{3000}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{FF00}}-\\x{{FFEF}}]', '', 'g')) >= length(text) THEN 0.85 ELSE 0.78 END::DOUBLE, 0)))::BIGINT AS size FROM p""")
def ocr_elements(spark, d):
    """Recognised lines as text elements in reading order."""
    return layout.text_elements(items(spark, d), KEYS, ["y1", "x1", "idx"], F.lit(H)).select(*KEYS, "name", "type", "text", "x", "y", "w", "h", "size")


CLEARING = rf"""CASE WHEN (contains(text, 'UNIVERSITY') OR contains(text, 'UNNERTY') OR contains(text, 'INSTITUTE') OR contains(text, 'COLLEGE') OR contains(text, 'GROUP') OR contains(text, 'CORP') OR contains(text, 'LTD') OR contains(text, 'INC') OR contains(text, 'LAB') OR contains(text, 'LOGO'))
  AND (ry < 0.15 OR ry > 0.85 OR rx < 0.16 OR rx > 0.85) THEN 'H1_logo_strip'
 WHEN length(text) = 1 AND regexp_matches(text, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}]') AND confidence < 0.55 THEN 'H2_single_cjk_lowconf'
 WHEN NOT contains(text, '…') AND text NOT IN ('.', '..') AND NOT regexp_matches(text, '[\p{{L}}\p{{N}}]') AND length(text) <= 4 AND confidence < 0.80 THEN 'H3_punct_symbol_only'
 WHEN regexp_matches(text, '^[-=>→←↑↓·•]+$') AND length(text) <= 6 AND confidence < 0.90 THEN 'H4_arrow_dash_fragment'
 WHEN NOT regexp_matches(text, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}]') AND NOT contains(text, '…') AND text <> '.' AND length(text) <= 8 AND h <= 15 AND confidence < 0.95 AND NOT (rx > 0.95 AND ry > 0.92) THEN 'H5_short_thin_lowconf'
 WHEN regexp_matches(text, '^[0-9OoDIlZ]{{1,3}}$') AND ry < 0.12 AND (rx > 0.80 OR rx < 0.15) AND confidence < 0.95 THEN 'H6_logo_digits_top_corner' END"""


@query(f"""WITH {ITEMS}, r AS (SELECT *, (x1 + x2) / 2 / {W} AS rx, (y1 + y2) / 2 / {H} AS ry FROM items) SELECT id, {CLEARING} AS rule FROM r""")
def clearing_rules(spark, d):
    """Each line's first rule of those by which a review clears decoration."""
    x = items(spark, d)
    return x.select("id", rules.clearing_rule(F.col("text"), F.col("confidence"), *Box.of(""), F.lit(W), F.lit(H)).alias("rule"))


READINGS = ITEMS + r""", readings AS (SELECT id, doc_id, slide, text AS a, confidence AS pa, CASE id % 5 WHEN 0 THEN text WHEN 1 THEN upper(text) WHEN 2 THEN left(text, length(text) - 1) WHEN 3 THEN '' ELSE 'zz' || left(text, 3) END AS b, ((id * 7) % 100) / 100::DOUBLE AS pb,
 CASE id % 7 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN left(text, length(text) - 1) ELSE 'q ' || right(text, 4) END AS c, ((id * 13) % 100) / 100::DOUBLE AS pc FROM items WHERE regexp_matches(text, '^[\x00-\x7F]*$')),
n AS (SELECT *, lower(regexp_replace(a, '[\x20\x09-\x0D]', '', 'g')) AS na, lower(regexp_replace(b, '[\x20\x09-\x0D]', '', 'g')) AS nb, lower(regexp_replace(c, '[\x20\x09-\x0D]', '', 'g')) AS nc FROM readings),
f AS (SELECT *, CASE WHEN a <> '' THEN pa ELSE -1 END AS qa, CASE WHEN b <> '' THEN pb ELSE -1 END AS qb, CASE WHEN c <> '' THEN pc ELSE -1 END AS qc, pa >= 0.95 AND a <> '' AS oa, pb >= 0.95 AND b <> '' AS ob, pc >= 0.95 AND c <> '' AS oc FROM n),
g AS (SELECT *, CASE WHEN c <> '' AND pc >= 0.30 THEN c WHEN qa >= qb AND qa >= qc THEN a WHEN qb >= qc THEN b ELSE c END AS best, CASE WHEN c <> '' AND pc >= 0.30 THEN pc ELSE greatest(qa, qb, qc) END AS best_p,
 CASE WHEN oc THEN c WHEN oa AND (NOT ob OR pa >= pb) THEN a ELSE b END AS among FROM f),
k AS (SELECT *, CASE WHEN na = '' AND nb = '' AND nc = '' THEN 'C_all_empty' WHEN na = nb AND nb = nc THEN 'A_strict_consensus' WHEN (na = nb AND na <> '') OR (na = nc AND na <> '') OR (nb = nc AND nb <> '') THEN 'B_majority'
 WHEN least(length(na), length(nb), length(nc)) >= 3 AND greatest(levenshtein(na, nb), levenshtein(na, nc), levenshtein(nb, nc)) <= 1 THEN 'D_edit_close' WHEN oa OR ob OR oc THEN 'D_prime_single_high_conf' WHEN best_p >= 0.85 THEN 'G_moderate_conf_fallback' ELSE 'F_disagree' END AS reason FROM g),
x AS (SELECT *, CASE WHEN reason[1] IN ('A', 'B', 'C') THEN 'green' WHEN reason = 'F_disagree' THEN 'red' ELSE 'yellow' END AS tier, CASE WHEN reason = 'C_all_empty' THEN '' WHEN reason = 'A_strict_consensus' THEN a
 WHEN reason = 'B_majority' THEN CASE WHEN na = nb AND na <> '' THEN CASE WHEN pb > pa THEN b ELSE a END WHEN na = nc AND na <> '' THEN CASE WHEN pc > pa THEN c ELSE a END ELSE CASE WHEN pc > pb THEN c ELSE b END END
 WHEN reason = 'D_prime_single_high_conf' THEN among ELSE best END AS suggested FROM k)"""
ENGINES = {"paddle": ("a", "pa"), "easyocr": ("b", "pb"), "tesseract": ("c", "pc")}


def readings(spark, d):
    """Three readings of each ASCII line, two of them damaged by the line's number."""
    t, i = F.col("text"), F.col("id")
    x = items(spark, d).filter(t.rlike(r"^[\x00-\x7F]*$"))
    m5, m7, cut = F.pmod(i, F.lit(5)), F.pmod(i, F.lit(7)), F.left(t, F.length(t) - 1)
    b = F.when(m5 == 0, t).when(m5 == 1, F.upper(t)).when(m5 == 2, cut).when(m5 == 3, "").otherwise(F.concat(F.lit("zz"), F.left(t, F.lit(3))))
    c = F.when(m7 == 0, t).when(m7 == 1, "").when(m7 == 2, cut).otherwise(F.concat(F.lit("q "), F.right(t, F.lit(4))))
    return x.select("id", *KEYS, t.alias("a"), F.col("confidence").alias("pa"), b.alias("b"), (F.pmod(i * 7, F.lit(100)) / 100.0).alias("pb"), c.alias("c"), (F.pmod(i * 13, F.lit(100)) / 100.0).alias("pc"), "x1", "y1", "x2", "y2")


@query(f"WITH {READINGS} SELECT id, tier, reason, suggested FROM x")
def engine_consensus(spark, d):
    """Three engines' readings of each line, by the ladder of agreement."""
    return readings(spark, d).select("id", rules.consensus(ENGINES, normalise=tx.normalise_ascii).alias("x")).select("id", "x.tier", "x.reason", F.col("x.text").alias("suggested"))


def _rescued(spark, d):
    r = readings(spark, d).select("*", rules.consensus(ENGINES, normalise=tx.normalise_ascii).alias("x"))
    m = F.pmod("id", F.lit(4))
    crop = F.when(m == 0, F.col("c")).when(m == 1, F.concat(F.lit("new "), F.col("a"))).when(m == 2, F.col("a")).otherwise(F.lit(""))
    return r.select("*", rules.rescue(F.col("x.tier"), F.col("x.reason"), F.col("x.text"), [F.col("a"), F.col("b"), F.col("c")], crop, F.pmod(F.col("id") * 3, F.lit(100)) / 100.0, normalise=tx.normalise_ascii).alias("y"))


RESCUED = READINGS + r""", crops AS (SELECT *, CASE id % 4 WHEN 0 THEN c WHEN 1 THEN 'new ' || a WHEN 2 THEN a ELSE '' END AS crop, ((id * 3) % 100) / 100::DOUBLE AS pcrop FROM x),
norm AS (SELECT *, lower(regexp_replace(crop, '[\x20\x09-\x0D]', '', 'g')) AS n2 FROM crops),
rescued AS (SELECT *, CASE WHEN tier <> 'red' OR n2 = '' OR n2 = na THEN reason WHEN n2 = nb THEN 'G_prime_paddle_crop_agrees_with_easyocr' WHEN n2 = nc THEN 'G_prime_paddle_crop_agrees_with_tesseract' WHEN pcrop >= 0.85 THEN 'G_prime_paddle_crop_moderate_conf' ELSE reason END AS reason2 FROM norm),
final AS (SELECT id, doc_id, slide, tier AS tier1, CASE WHEN reason2 LIKE 'G_prime%' THEN 'yellow' ELSE tier END AS tier2, reason2, CASE WHEN reason2 LIKE 'G_prime%' THEN crop ELSE suggested END AS text2 FROM rescued)"""


@query(f"WITH {RESCUED} SELECT id, tier2 AS tier, reason2 AS reason, text2 AS suggested FROM final")
def engine_rescue(spark, d):
    """The same after a second look of the first engine at what is red."""
    return _rescued(spark, d).select("id", "y.tier", "y.reason", F.col("y.text").alias("suggested"))


@query(f"""WITH {RESCUED} SELECT doc_id, count(*) FILTER (WHERE tier2 = 'green') AS green, count(*) FILTER (WHERE tier2 = 'yellow') AS yellow, count(*) FILTER (WHERE tier2 = 'red') AS red,
 count(*) FILTER (WHERE tier1 = 'red') AS attempted, count(*) FILTER (WHERE tier1 <> tier2) AS upgraded FROM final GROUP BY doc_id""")
def tier_counts(spark, d):
    """A document's entries by tier, and what the second look changed."""
    is_ = lambda c, t: F.count_if(F.col(c) == t)
    return _rescued(spark, d).groupBy("doc_id").agg(*(is_("y.tier", t).alias(t) for t in ("green", "yellow", "red")), is_("x.tier", "red").alias("attempted"), F.count_if(F.col("x.tier") != F.col("y.tier")).alias("upgraded"))


@query(f"""WITH {ITEMS}, r AS (SELECT *, (x1 + x2) / 2 / {W} AS rx, (y1 + y2) / 2 / {H} AS ry, row_number() OVER (PARTITION BY doc_id, slide ORDER BY confidence, idx) AS rank FROM items WHERE confidence < 0.95),
e AS (SELECT id, doc_id, slide, text, confidence, x1, y1, x2, y2, {CLEARING} AS rule FROM r WHERE rank <= 5)
SELECT id, doc_id, slide, text AS original_text, confidence, [x1, y1, x2, y2]::VARCHAR AS bbox, CASE WHEN rule IS NULL THEN text ELSE '' END AS corrected_text, 'auto-cleared by ' || rule AS notes FROM e""")
def review_packet(spark, d):
    """The five least sure lines of a slide below 0.95, as entries of a review, cleared where a rule says so."""
    x = windows.top_k(items(spark, d).filter("coalesce(confidence, 1.0) < 0.95"), KEYS, ["confidence", "idx"], 5)
    x = x.withColumn("rule", rules.clearing_rule(F.col("text"), F.col("confidence"), *Box.of(""), F.lit(W), F.lit(H)))
    bbox = F.concat(F.lit("["), F.concat_ws(", ", *(F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2"))), F.lit("]"))
    return x.select("id", *KEYS, F.col("text").alias("original_text"), "confidence", bbox.alias("bbox"), F.when(F.col("rule").isNull(), F.col("text")).otherwise("").alias("corrected_text"), F.concat(F.lit("auto-cleared by "), F.col("rule")).alias("notes"))


@query(f"""WITH {RESCUED}, i AS (SELECT *, (x1 + x2) / 2 / {W} AS rx, (y1 + y2) / 2 / {H} AS ry FROM items), c AS (SELECT id, {CLEARING} AS rule FROM i)
SELECT doc_id, slide, count(*) FILTER (WHERE tier2 = 'yellow') AS yellow, count(*) FILTER (WHERE tier2 = 'red') AS red FROM final JOIN c USING (id) WHERE rule IS NULL AND tier2 <> 'green' GROUP BY doc_id, slide""")
def pending_review(spark, d):
    """Slides with entries that are still to be looked at: weak or no consensus, and not cleared by a rule."""
    x = _rescued(spark, d)
    x = x.select(*KEYS, "y.tier", rules.clearing_rule(F.col("a"), F.col("pa"), *Box.of(""), F.lit(W), F.lit(H)).alias("rule"))
    x = x.groupBy(*KEYS).agg(*(F.count_if(F.col("rule").isNull() & (F.col("tier") == t)).alias(t) for t in ("yellow", "red")))
    return x.filter("yellow + red > 0")  # after the sums: a filter on a tier would work the ladder out twice


# containers --------------------------------------------------------------------------------
MEMBERS = f""", m0 AS (SELECT t.doc_id, t.slide, t.id, c.cid, c.name, (c.x2 - c.x1) * (c.y2 - c.y1) AS area FROM items t JOIN containers c USING (doc_id, slide)
 WHERE (t.x1 + t.x2) / 2 BETWEEN c.x1 - 6 AND c.x2 + 6 AND (t.y1 + t.y2) / 2 BETWEEN c.y1 - 6 AND c.y2 + 6 AND {MEET.format('t', 'c')} / greatest(1, t.w * t.h) >= 0.55),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, slide, cid) AS texts_in, row_number() OVER (PARTITION BY doc_id, slide, id ORDER BY area, cid) = 1 AS direct FROM m0)"""


@query(f"WITH {ITEMS}{MEMBERS} SELECT id, cid, area, texts_in, direct FROM m")
def container_texts(spark, d):
    """Each line in each container that holds it."""
    return layout.members(items(spark, d), containers(spark, d), KEYS).select("id", "cid", "area", "texts_in", "direct")


SIBLINGS = """, s AS (SELECT a.doc_id, a.slide, a.cid AS ca, b.cid AS cb, a.x1 AS ax1, a.y1 AS ay1, a.x2 - a.x1 AS aw, a.y2 - a.y1 AS ah, b.x1 AS bx1, b.y1 AS by1, b.x2 - b.x1 AS bw, b.y2 - b.y1 AS bh FROM containers a JOIN containers b USING (doc_id, slide) WHERE a.cid <> b.cid
 AND greatest(a.x2 - a.x1, b.x2 - b.x1) / least(a.x2 - a.x1, b.x2 - b.x1) <= 1.18 AND greatest(a.y2 - a.y1, b.y2 - b.y1) / least(a.y2 - a.y1, b.y2 - b.y1) <= 1.22
 AND (abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= greatest(12.0, least(a.y2 - a.y1, b.y2 - b.y1) * 0.18) OR abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) <= greatest(12.0, least(a.x2 - a.x1, b.x2 - b.x1) * 0.18)))"""
EDGES = MEMBERS + SIBLINGS + f""", pairs AS (
 SELECT p.doc_id, p.slide, p.id AS a_id, q.id AS b_id, CASE WHEN p.texts_in >= 3 THEN {{'area': p.area, 'cid': p.cid, 'name': p.name}} END AS scope, p.direct AND q.direct AS same_parent, false AS near, false AS slot, false AS band FROM m p JOIN m q USING (doc_id, slide, cid) WHERE p.id < q.id
 UNION ALL SELECT doc_id, slide, a_id, b_id, NULL, false, true, o0 <= 0.08 AND o1 <= 0.10 AND o2 <= 0.22 AND o3 <= 0.16, least(pa, pb) >= 0.45 AND o0 <= 0.12 AND o1 <= 0.12 AND o3 <= 0.12 FROM
 (SELECT s.doc_id, s.slide, p.id AS a_id, q.id AS b_id, abs((t.x1 - ax1) / aw - (u.x1 - bx1) / bw) AS o0, abs((t.y1 - ay1) / ah - (u.y1 - by1) / bh) AS o1, abs(t.w / aw - u.w / bw) AS o2, abs(t.h / ah - u.h / bh) AS o3, (t.y1 - ay1) / ah AS pa, (u.y1 - by1) / bh AS pb
  FROM s JOIN m p ON p.doc_id = s.doc_id AND p.slide = s.slide AND p.cid = ca JOIN m q ON q.doc_id = s.doc_id AND q.slide = s.slide AND q.cid = cb JOIN items t ON t.id = p.id JOIN items u ON u.id = q.id WHERE p.id < q.id)),
g1 AS (SELECT doc_id, slide, a_id, b_id, min(scope) AS scope, bool_or(same_parent) AS same_parent, bool_or(near) AS near, bool_or(slot) AS slot, bool_or(band) AS band FROM pairs GROUP BY ALL),
it AS (SELECT *, {FAMILY} AS family, length(regexp_replace(text, '[\\x20\\x09-\\x0D\\x{{00A0}}\\x{{3000}}]', '', 'g')) AS vis FROM (SELECT *, {RGB} FROM items)),
g2 AS (SELECT g1.*, a.align AS align, a.align = b.align AS same_align, a.family AS family, a.family = b.family AS same_family, sqrt((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2) AS dist, abs(a.size - b.size) AS delta, greatest(a.size, b.size) / greatest(1, least(a.size, b.size)) AS ratio, a.bold AND b.bold AS bold,
 least(a.vis, b.vis) AS lv, greatest(a.vis, b.vis) AS hv, CASE WHEN a.y1 <= b.y1 THEN b.y1 - a.y2 ELSE a.y1 - b.y2 END AS gap, least(a.h, b.h) AS lh, (a.h + b.h) / 2 AS mh, abs(a.x1 - b.x1) AS dx, abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) AS dcy, abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) AS dcx, least(a.w, b.w) AS lw,
 greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) AS ygap FROM g1 JOIN it a ON a.id = a_id JOIN it b ON b.id = b_id),
g3 AS (SELECT *, same_align AND delta <= 2 AND ratio <= 1.75 AND same_family AND dist <= CASE WHEN family IN ('white', 'black') THEN 38 WHEN family IN ('blue', 'red', 'gray') THEN 78 ELSE 45 END AS style, band AND family = 'red' AND same_family AND bold AND lv >= 6 AS alert,
 align = 'left' AND same_align AND family = 'blue' AND same_family AND bold AND lv >= 2 AND hv <= 48 AND (same_parent OR scope IS NOT NULL OR near) AND gap >= -0.12 * lh AND gap <= greatest(86.0, mh * 1.85) AND dx <= 26 AS listed,
 dcy <= greatest(4.0, lh * 0.42) AS rw, ygap <= 42 AND (dx <= greatest(7.0, least(18.0, lw * 0.14)) OR dcx <= 10) AS col FROM g2),
edges AS (SELECT doc_id, slide, a_id, b_id, concat_ws(',', CASE WHEN rw THEN 'row' END, CASE WHEN col THEN 'column' END, CASE WHEN slot THEN 'relative_slot' END, CASE WHEN alert THEN 'relative_alert_band' END, CASE WHEN listed THEN 'vertical_list_slot' END, 'scope:' || scope.name, CASE WHEN same_parent THEN 'same_parent' END) AS reasons
 FROM g3 WHERE style AND (scope IS NOT NULL OR slot OR alert OR listed OR same_parent) AND (rw OR col OR slot OR alert OR listed))"""


@query(f"WITH {ITEMS}{EDGES} SELECT a_id, b_id, reasons FROM edges")
def style_edges(spark, d):
    """Pairs of lines of one slot, and why. Sizes here are under 20, so none are compact titles."""
    t = stash(items(spark, d), "items")
    e = layout.style_edges(t, stash(containers(spark, d, t), "containers"), KEYS)
    return e.select("a_id", "b_id", F.concat_ws(",", "reasons").alias("reasons"))


def _classes(spark, d):
    t = stash(items(spark, d), "items")
    e = layout.style_edges(t, stash(containers(spark, d, t), "containers"), KEYS)
    return t, graph.components_within(e, KEYS, "a_id", "b_id").select(F.col("node").alias("id"), "component")


@query(f"""WITH RECURSIVE {ITEMS}{EDGES}, both_ways AS (SELECT a_id AS u, b_id AS v FROM edges UNION SELECT b_id, a_id FROM edges), walk(node, seen) AS (SELECT u, u FROM both_ways UNION SELECT v, seen FROM walk JOIN both_ways ON u = node), comp AS (SELECT node AS id, min(seen) AS component FROM walk GROUP BY node),
k AS (SELECT doc_id, slide, component, count(*) AS n, floor(median(size) + 0.5)::BIGINT AS suggested_size, max(size) - min(size) AS size_delta, count(*) FILTER (WHERE bold) AS bolds, count(*) FILTER (WHERE align = 'center') AS centred, arg_min(family, id) AS colour_family, min(y1) AS y1, min(x1) AS x1 FROM comp JOIN it USING (id) GROUP BY doc_id, slide, component)
SELECT doc_id, slide, 'slot_' || lpad(row_number() OVER (PARTITION BY doc_id, slide ORDER BY y1, x1, component)::VARCHAR, 2, '0') AS class_id, component, n AS "count", suggested_size, CASE WHEN centred * 2 >= n THEN 'center' ELSE 'left' END AS align, bolds * 2 > n AS bold, greatest(bolds, n - bolds) >= greatest(3, n - 1) AS bold_stable, colour_family FROM k WHERE size_delta <= 2""")
def style_classes(spark, d):
    """Slots of a slide: what the pairs connect, with the size, weight and alignment that most have."""
    t, c = _classes(spark, d)
    return layout.style_classes(t, c, KEYS).select(*KEYS, "class_id", "component", "count", "suggested_size", "align", "bold", "bold_stable", "colour_family")


@query(f"""WITH RECURSIVE {ITEMS}{MEMBERS}{SIBLINGS}, held AS (SELECT DISTINCT doc_id, slide, cid FROM m), e AS (SELECT s.doc_id, s.slide, ca, cb FROM s JOIN held p ON p.doc_id = s.doc_id AND p.slide = s.slide AND p.cid = ca JOIN held q ON q.doc_id = s.doc_id AND q.slide = s.slide AND q.cid = cb),
walk(doc_id, slide, node, seen) AS (SELECT doc_id, slide, ca, ca FROM e UNION SELECT w.doc_id, w.slide, e.cb, w.seen FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.slide = w.slide AND e.ca = w.node) SELECT doc_id, slide, node AS cid, min(seen) AS "group" FROM walk GROUP BY doc_id, slide, node""")
def sibling_groups(spark, d):
    """Containers with texts that stand in one row or column with others like them."""
    c = containers(spark, d)
    held = layout.members(items(spark, d), c, KEYS).select(*KEYS, "cid").distinct()
    own = lambda x: (F.col("doc_id") * 1048576 + F.col("slide")) * 8 + F.col(x)
    e = layout.siblings(c.join(held, [*KEYS, "cid"], "left_semi"), KEYS).select(*KEYS, own("a_cid").alias("a"), own("b_cid").alias("b"))
    g = graph.components_within(e, KEYS, "a", "b")
    low = lambda x: F.pmod(x, F.lit(8))
    page = F.floor(F.col("node") / 8)
    return g.select(F.floor(page / 1048576).alias("doc_id"), F.pmod(page, F.lit(1048576)).alias("slide"), low(F.col("node")).alias("cid"), low(F.col("component")).alias("group"))


@query(f"""WITH RECURSIVE {ITEMS}{MEMBERS}, it AS (SELECT *, {FAMILY} AS family FROM (SELECT *, {RGB} FROM items)), k AS (SELECT m.cid, it.* FROM m JOIN it USING (id) WHERE direct AND align = 'left'),
e AS (SELECT a.id AS u, b.id AS v FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.slide = b.slide AND a.cid = b.cid AND a.id <> b.id WHERE a.bold = b.bold AND abs(a.size - b.size) <= 2 AND (a.family = b.family OR (a.family IN ('black', 'gray') AND b.family IN ('black', 'gray'))) AND abs(a.x1 - b.x1) <= 24),
walk(node, seen) AS (SELECT u, u FROM e UNION SELECT v, seen FROM walk JOIN e ON u = node), comp AS (SELECT node AS id, min(seen) AS component FROM walk GROUP BY node),
g AS (SELECT *, lead((y1 + y2) / 2) OVER (PARTITION BY component ORDER BY (y1 + y2) / 2, id) - (y1 + y2) / 2 AS step FROM comp JOIN k USING (id))
SELECT component, any_value(cid) AS direct_parent, count(*) AS n, round(median(x1), 3) AS target_x, count(*) FILTER (WHERE abs(x1 - mx) >= 0.15) AS moved FROM (SELECT *, median(x1) OVER (PARTITION BY component) AS mx FROM g) GROUP BY component
HAVING count(*) >= 3 AND max((y1 + y2) / 2) - min((y1 + y2) / 2) > median(h) * 0.75 AND max(step) <= greatest(36.0, median(h) * 2.2) AND max(x1) - min(x1) <= 24""")
def column_stacks(spark, d):
    """Stacks of left-aligned lines of one style in a container, and the x they snap to."""
    t = items(spark, d)
    m = layout.members(t, containers(spark, d), KEYS).filter("direct").select("id", "cid")
    k = t.filter("align = 'left'").join(m, "id").withColumn("family", Colour.parse(F.col("color")).family)
    k = k.withColumn("tone", F.when(F.col("family").isin("black", "gray"), "dark").otherwise(F.col("family")))
    side = lambda s: k.select(*KEYS, "cid", "bold", "tone", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "size", "x1")))
    e = side("a").join(side("b"), [*KEYS, "cid", "bold", "tone"]).filter("a_id < b_id and abs(a_size - b_size) <= 2 and abs(a_x1 - b_x1) <= 24")
    c = graph.components_within(e, KEYS, "a_id", "b_id").select(F.col("node").alias("id"), "component")
    cy = (F.col("y1") + F.col("y2")) / 2
    g = k.join(c, "id").withColumn("cy", cy)
    g = g.withColumn("step", F.lead("cy").over(windows._w(["component"], ["cy", "id"])) - F.col("cy"))
    s = g.groupBy("component").agg(F.min("cid").alias("direct_parent"), F.count("*").alias("n"), F.percentile("x1", F.lit(0.5)).alias("target_x"), F.collect_list("x1").alias("xs"), F.percentile("h", F.lit(0.5)).alias("mh"), (F.max("cy") - F.min("cy")).alias("spread"), F.max("step").alias("step"))
    s = s.filter((F.col("n") >= 3) & (F.col("spread") > F.col("mh") * 0.75) & (F.col("step") <= F.greatest(F.lit(36.0), F.col("mh") * 2.2)) & (F.array_max("xs") - F.array_min("xs") <= 24))
    return s.select("component", "direct_parent", "n", F.round("target_x", 3).alias("target_x"), F.size(F.filter("xs", lambda x: F.abs(x - F.col("target_x")) >= 0.15)).cast("long").alias("moved"))


#: Lines as connectors, children and outlines of containers: their boxes as they are, the role by number.
ASSETS = f""", assets AS (SELECT doc_id, slide, id, {['connector', 'subicon', 'outline', 'text', 'container']}[id % 5 + 1] AS role, x1, y1, x2, y2 FROM items UNION ALL SELECT doc_id, slide, -1 - cid, role, x1, y1, x2, y2 FROM containers)"""
BORDER = """ AND {m} >= 0.80 * greatest(1, (c.x2 - c.x1) * (c.y2 - c.y1)) AND ((c.x2 - c.x1 >= greatest(12.0, (c.y2 - c.y1) * 2.0) AND (c.y1 - p.y1 <= {b} OR p.y2 - c.y2 <= {b})) OR (c.y2 - c.y1 >= greatest(12.0, (c.x2 - c.x1) * 2.0) AND (c.x1 - p.x1 <= {b} OR p.x2 - c.x2 <= {b}))
 OR ((c.y1 - p.y1 <= {b} OR p.y2 - c.y2 <= {b}) AND (c.x1 - p.x1 <= {b} OR p.x2 - c.x2 <= {b})))""".format(m=MEET.format("p", "c"), b="greatest(4, least(14, round_even(least(p.x2 - p.x1, p.y2 - p.y1) * 0.22, 0)))")


def assets(spark, d):
    own = items(spark, d).select(*KEYS, "id", _pick(["connector", "subicon", "outline", "text", "container"], F.pmod("id", F.lit(5))).alias("role"), "x1", "y1", "x2", "y2")
    return own.union(containers(spark, d).select(*KEYS, (-1 - F.col("cid")).alias("id"), "role", "x1", "y1", "x2", "y2"))


@query(f"WITH {ITEMS}{ASSETS} SELECT doc_id, id FROM assets c WHERE role = 'connector' AND NOT EXISTS (SELECT 1 FROM containers p WHERE p.doc_id = c.doc_id AND p.slide = c.slide AND p.role = 'container'{BORDER})")
def free_connectors(spark, d):
    """Connectors that are no part of a container's border."""
    a = assets(spark, d)
    return layout.without_border_connectors(a.filter("role = 'connector'"), containers(spark, d).filter("role = 'container'"), KEYS).select("doc_id", "id")


@query(f"""WITH {ITEMS}{ASSETS}, pairs AS (SELECT p.doc_id, p.id AS parent, c.id AS child FROM assets p JOIN assets c USING (doc_id, slide) WHERE p.id <> c.id AND c.role NOT IN ('background', 'outline') AND greatest(1, (c.x2 - c.x1) * (c.y2 - c.y1)) < greatest(1, (p.x2 - p.x1) * (p.y2 - p.y1)) * 0.55
 AND (c.role IN ('subicon', 'badge_subicon', 'line_subicon', 'internal', 'connector') OR ((c.x2 - c.x1) * (c.y2 - c.y1) <= 18000 AND greatest(c.x2 - c.x1, c.y2 - c.y1) <= 180) OR ((c.x2 - c.x1) * (c.y2 - c.y1) <= 30000 AND least(c.x2 - c.x1, c.y2 - c.y1) <= 90 AND c.x2 - c.x1 <= 0.95 * (p.x2 - p.x1) AND c.y2 - c.y1 <= 0.80 * (p.y2 - p.y1)))
 AND {MEET.format('p', 'c')} >= 0.85 * greatest(1, (c.x2 - c.x1) * (c.y2 - c.y1)) AND {MEET.format('p', 'c')} > 0 AND NOT (p.role = 'container' AND c.role = 'connector'{BORDER})) SELECT doc_id, parent, child FROM pairs""")
def child_assets(spark, d):
    """Assets that are part of a larger one."""
    return layout.children(assets(spark, d), KEYS).select("doc_id", "parent", "child")


OUTLINES = ", outs AS (SELECT doc_id, slide, id, x1, y1, x2, y2 FROM items WHERE id % 3 <> 0 UNION ALL SELECT doc_id, slide, -1 - cid, x1, y1, x2, y2 FROM containers)"


def outlines(spark, d):
    o = items(spark, d).filter("pmod(id, 3) <> 0").select(*KEYS, "id", "x1", "y1", "x2", "y2")
    return o.union(containers(spark, d).select(*KEYS, (-1 - F.col("cid")).alias("id"), "x1", "y1", "x2", "y2"))


@query(f"""WITH {ITEMS}{OUTLINES}, h AS (SELECT a.doc_id, a.slide, a.id, b.id AS other, b.x1, b.y1, b.x2, b.y2 FROM outs a JOIN outs b USING (doc_id, slide) WHERE a.id <> b.id AND greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1)) < 0.85 * greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1)) AND {MEET.format('a', 'b')} > 0 AND {MEET.format('a', 'b')} >= 0.72 * greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1)))
SELECT DISTINCT p.doc_id, p.slide, p.id FROM h p JOIN h q ON p.doc_id = q.doc_id AND p.slide = q.slide AND p.id = q.id AND p.other < q.other
 WHERE greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) >= 0.70 * least(p.y2 - p.y1, q.y2 - q.y1) AND greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) <= 0.20 * least(p.x2 - p.x1, q.x2 - q.x1)""")
def redundant_outlines(spark, d):
    """Outlines around two cards side by side."""
    return layout.redundant_outlines(outlines(spark, d), KEYS).select(*KEYS, "id")


@query(f"""WITH {ITEMS} SELECT DISTINCT o.doc_id, o.id FROM items o JOIN containers p USING (doc_id, slide) WHERE o.id % 3 <> 0 AND p.role NOT IN ('outline', 'background', 'internal', 'subicon', 'badge_subicon', 'connector', 'line_subicon') AND (p.x2 - p.x1) * (p.y2 - p.y1) <= 0.85 * {W * H}
 AND (p.x2 - p.x1) * (p.y2 - p.y1) >= 2.8 * greatest(1, o.w * o.h) AND {MEET.format('o', 'p')} >= 0.92 * greatest(1, o.w * o.h)""")
def carried_outlines(spark, d):
    """Outlines that a larger asset already shows."""
    own = items(spark, d).filter("pmod(id, 3) <> 0").select(*KEYS, "id", "x1", "y1", "x2", "y2")
    return layout.carried_outlines(own, containers(spark, d).withColumnRenamed("cid", "id"), KEYS, W * H).select("doc_id", "id")


@query(f"""WITH {ITEMS}, b AS (SELECT t.id, t.x1 AS tx, t.w, p.x1, p.x2, row_number() OVER (PARTITION BY t.id ORDER BY (p.x2 - p.x1) * (p.y2 - p.y1), p.cid) AS rn FROM items t JOIN containers p USING (doc_id, slide) WHERE length(t.text) <= 16 AND p.x1 < t.x1 AND p.y1 < t.y1 AND p.x2 > t.x2 AND p.y2 > t.y2)
SELECT id, round_even((x1 + x2) / 2 - w / 2, 0)::BIGINT AS new_x1 FROM b WHERE rn = 1 AND abs(tx + w / 2 - (x1 + x2) / 2) <= least(0.3 * (x2 - x1), 120)""")
def centred_titles(spark, d):
    """Short lines that are centred in the smallest image around them; the tolerance is wide, as these boxes are made up."""
    return layout.centred_titles(items(spark, d), containers(spark, d), KEYS, share=0.3, most=120, longest=16).select("id", "new_x1")


# texts and colours -------------------------------------------------------------------------
@query(f"""WITH {ITEMS}, c AS (SELECT id, (id * 40) % 256 AS r, (id * 24 + 90) % 256 AS g, (id * 60 + 30) % 256 AS b, CASE WHEN id % 2 = 0 THEN 255 ELSE 40 END AS ground FROM items), l AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, trunc(0.114 * b + 0.587 * g + 0.299 * r)::BIGINT AS luminance, trunc(0.114 * ground + 0.587 * ground + 0.299 * ground) AS under FROM c)
SELECT id, luminance, {FAMILY} AS family, CASE WHEN under < 110 AND luminance > 170 THEN '#FFFFFF' WHEN r > g + 30 AND r > b + 30 AND r > 150 THEN '#D43E3E' WHEN b > r + 28 AND b > g + 18 AND b > 80 THEN '#054798' WHEN hi < 80 OR (hi < 130 AND hi - lo < 12) THEN '#222222' ELSE format('#{{:02X}}{{:02X}}{{:02X}}', r, g, b) END AS canonical FROM l""")
def colour_rules(spark, d):
    """Families and canonical forms of colours made from ids."""
    i = F.col("id")
    c = Colour(*(F.pmod(x, F.lit(256)) for x in (i * 40, i * 24 + 90, i * 60 + 30)))
    g = F.when(F.pmod(i, F.lit(2)) == 0, 255).otherwise(40)
    return items(spark, d).select("id", c.luminance.cast("long").alias("luminance"), c.family.alias("family"), c.canonical(Colour(g, g, g)).alias("canonical"))


@query(f"""WITH {ITEMS}, f AS (SELECT id, slide, idx, h * 0.75 * CASE WHEN length(text) <= 4 THEN 0.78 WHEN length(text) <= 12 THEN 0.74 ELSE 0.71 END::DOUBLE * (1 + id % 4) AS raw FROM items), g AS (SELECT *, greatest(8.0, CASE WHEN raw > 60 THEN least(88.0, raw) ELSE least(36.0, raw) END) AS pt FROM f)
SELECT id, (SELECT arg_min(v, abs(v - pt) * 1000 + v / 1000.0) FROM (SELECT unnest({rules.SIZES}) AS v))::BIGINT AS size FROM g""")
def font_sizes(spark, d):
    """Sizes of type by the height of boxes, on a ladder."""
    return items(spark, d).select("id", rules.font_size(F.col("text"), F.col("h"), 0.75 * (1 + F.pmod("id", F.lit(4)))).cast("long").alias("size"))


def _sql_class(p: str) -> str:
    return p.replace("'", "''")


@query(rf"""WITH {LINES}, t AS (SELECT DISTINCT left(line, 40) AS line FROM lines WHERE line <> ''), v AS (SELECT *, regexp_replace(line, '[\x20\x09-\x0D\x{{00A0}}\x{{3000}}]', '', 'g') AS x, regexp_extract(line, '^[\x20\x09-\x0D]*\(?([0-9]{{1,3}})([.)、．])\)?[\x20\x09-\x0D]*', 0) AS o, regexp_extract(line, '^[\x20\x09-\x0D]*\(?([0-9]{{1,3}})([.)、．])\)?[\x20\x09-\x0D]*', 2) AS s FROM t)
SELECT line, length(x) <= 8 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[0-9.,+-]+(?:{'|'.join(tx.STAT_UNITS)})$') AS stat, length(line) <= 16 AND length(x) = length(line) AND NOT regexp_matches(line, '[，。！？；;,:：、/\\()（）\[\]{{}}<>《》]') AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 2 AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 0.55 * length(line) AS label,
 CASE WHEN contains('{tx.BULLETS}', left(line, 1)) THEN 'bullet' WHEN o <> '' AND NOT (s IN ('.', '．') AND regexp_matches(substr(line, length(o) + 1, 1), '[0-9]')) THEN 'ordered' END AS prefix, translate(line, '{tx.DOTS}', '{tx.DOT * 3}') AS dots, regexp_matches(line, '^[\p{{P}}\p{{S}}\s]*$') AS punctuation,
 round({' + '.join(f"{w} * length(regexp_replace(line, '[^{_sql_class(p[1:-1])}]', '', 'g'))" for p, w in tx.WIDTHS)} + length(regexp_replace(line, '[{''.join(_sql_class(p[1:-1]) if not p.startswith('[-') else '+/=\\-' for p, _ in tx.WIDTHS)}]', '', 'g')), 6)::DOUBLE AS units,
 {' OR '.join(f"contains(line, '{w}')" for w in tx.PLACEHOLDERS)} AS placeholder, CASE WHEN length(line) <= 4 THEN 'short' WHEN length(line) <= 12 THEN 'medium' ELSE 'long' END AS bucket FROM v""")
def text_kinds(spark, d):
    """What the starts of lines are as text of a slide: numbers with units, labels, list items, punctuation; and their width."""
    t = F.col("line")
    x = lines(spark, d).filter("line <> ''").select(F.left("line", F.lit(40)).alias("line")).distinct()
    return x.select("line", tx.is_stat_value(t).alias("stat"), tx.compact_label(t).alias("label"), tx.list_prefix(t)["kind"].alias("prefix"), tx.safe_dots(t).alias("dots"), tx.is_punctuation(t).alias("punctuation"), tx.width_units(t).alias("units"), tx.has_placeholder(t).alias("placeholder"), tx.length_bucket(t).alias("bucket"))


@query(f"""WITH {ITEMS}, o AS (SELECT doc_id, slide, 'image' AS type, role, cid AS id, x1, y1 FROM containers UNION ALL SELECT doc_id, slide, 'text', NULL, id, x1, y1 FROM items)
SELECT doc_id, slide, type, id, row_number() OVER (PARTITION BY doc_id, slide ORDER BY type = 'text', CASE WHEN type = 'text' THEN 0 WHEN role = 'background' THEN 0 WHEN role = 'outline' THEN 2 WHEN role = 'internal' THEN 3 WHEN role IN ('badge_subicon', 'connector', 'line_subicon', 'subicon') THEN 4 ELSE 1 END, y1, x1, id) - 1 AS z FROM o""")
def drawing_order(spark, d):
    """Images by role, then texts, each from top to bottom."""
    o = containers(spark, d).select(*KEYS, F.lit("image").alias("type"), "role", F.col("cid").alias("id"), "x1", "y1").union(items(spark, d).select(*KEYS, F.lit("text").alias("type"), F.lit(None).cast("string").alias("role"), "id", "x1", "y1"))
    rank = F.row_number().over(windows._w(KEYS, [*layout.drawing_order(F.col("type"), F.col("role"), F.col("y1"), F.col("x1")), "id"])) - 1
    return o.select(*KEYS, "type", "id", rank.cast("long").alias("z"))


@query(f"""WITH {ITEMS}, k AS (SELECT *, (id * 7) % 90 - 40 AS dx, w + (id % 13) - 6 AS rw, h + (id % 5) - 2 AS rh, length(regexp_replace(text, '[\\x20\\x09-\\x0D\\x{{00A0}}\\x{{3000}}]', '', 'g')) AS n FROM items),
r AS (SELECT *, greatest(0.35, least(2.5, greatest(1.0, h) / greatest(1.0, rh)))::DOUBLE AS bh, greatest(0.35, least(2.5, greatest(1.0, w) / greatest(1.0, rw)))::DOUBLE AS bw FROM k),
u AS (SELECT *, CASE WHEN n <= 4 THEN 0.24 WHEN n <= 8 THEN 0.18 ELSE 0.12 END::DOUBLE * CASE WHEN bw BETWEEN 0.92 AND 1.08 THEN 0.55 ELSE 1.0 END::DOUBLE AS wt FROM r), q AS (SELECT *, greatest(0.94, least(1.06, exp((1 - wt) * ln(bh) + wt * ln(bw)))) AS ratio FROM u)
SELECT id, round(CASE WHEN abs(ratio - 1) < 0.012 THEN 1.0 ELSE ratio END, 9)::DOUBLE AS ratio, CASE WHEN abs(greatest(-30.0, least(30.0, dx / 10))) < 0.15 THEN 0.0 ELSE greatest(-30.0, least(30.0, dx / 10)) END::DOUBLE AS shift FROM q""")
def calibration_steps(spark, d):
    """Corrections of sizes and positions against boxes that are a little off."""
    x, i = items(spark, d), F.col("id")
    ratio = rules.size_step(F.col("w").cast("double"), F.col("h").cast("double"), (F.col("w") + F.pmod(i, F.lit(13)) - 6).cast("double"), (F.col("h") + F.pmod(i, F.lit(5)) - 2).cast("double"), F.col("text"))
    return x.select("id", F.round(ratio, 9).alias("ratio"), rules.shift((F.pmod(i * 7, F.lit(90)) - 40) / 10).alias("shift"))


@query()
def spread_hues(spark, d):
    """Fallback colours of a slide's lines."""
    return items(spark, d).select("id", spread_hue(F.col("slide"), F.col("idx")).alias("colour"))


@query()
def slide_folds(spark, d):
    """Sizes, groups and colours that depend on the order of a slide's texts."""
    return folds.folded(items(spark, d).select(*KEYS, "id", "text", "x1", "y1", "x2", "y2", "size", "bold", "color"), KEYS, "id")


MARKS = rf""", o AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM items WHERE length(text) + length(regexp_replace(text, '[^\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7A3}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) <= 40),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, slide FROM items)), marks AS (SELECT text, count(DISTINCT doc_id * 1048576 + slide) AS pages, trunc(median(cx))::BIGINT AS mid_x, trunc(median(cy))::BIGINT AS mid_y FROM o GROUP BY text
 HAVING count(DISTINCT doc_id * 1048576 + slide) >= (SELECT greatest(2, round_even(0.001 * n, 0)) FROM n) AND max(cx) - min(cx) <= 600 AND max(cy) - min(cy) <= 600)"""


def _marks(spark, d):
    """Texts of a weighted length of 40 at most that enough slides have at about one place; the bounds are wide, as these places are made up."""
    x = items(spark, d)
    n = x.select(*KEYS).distinct().count()
    page = F.col("doc_id") * 1048576 + F.col("slide")
    o = x.filter(tx.weighted_length(F.col("text")) <= 40).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    spread = lambda c: F.max(c) - F.min(c)
    g = o.groupBy("text").agg(F.countDistinct(page).alias("pages"), spread("cx").alias("sx"), spread("cy").alias("sy"), F.percentile("cx", F.lit(0.5)).cast("long").alias("mid_x"), F.percentile("cy", F.lit(0.5)).cast("long").alias("mid_y"))
    return x, g.filter((F.col("pages") >= max(2, round(0.001 * n))) & (F.col("sx") <= 600) & (F.col("sy") <= 600)).select("text", "pages", "mid_x", "mid_y")


@query(f"WITH {ITEMS}{MARKS} SELECT text, pages, mid_x, mid_y FROM marks")
def template_marks(spark, d):
    """Texts that a template puts on many slides."""
    return _marks(spark, d)[1]


@query(f"WITH {ITEMS}{MARKS} SELECT id FROM items WHERE text IN (SELECT text FROM marks) UNION SELECT id FROM items WHERE text IN (SELECT text FROM items WHERE doc_id % 50 = 0)")
def flagged_texts(spark, d):
    """Lines that are marks of a template or on a whitelist, each once; documents by number stand for the whitelist."""
    x, marks = _marks(spark, d)
    white = x.filter("pmod(doc_id, 50) = 0").select("text").distinct()
    return x.join(marks, "text", "left_semi").select("id").union(x.join(white, "text", "left_semi").select("id")).distinct()


@query(rf"""WITH {ITEMS}, p AS (SELECT *, CASE WHEN regexp_matches(text, '^[^|丨]{{0,3}}[|丨]') THEN regexp_replace(regexp_extract(text, '^[^|丨]{{0,3}}[|丨](.*)$', 1), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') ELSE '' END AS rest FROM (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'ic|' || text ELSE text END AS text) FROM items))
SELECT id, CASE WHEN regexp_matches(rest, '[\p{{L}}\p{{N}}]') AND x1 + greatest(h, 25) + 10 < x2 THEN rest ELSE text END AS text, x1 + CASE WHEN regexp_matches(rest, '[\p{{L}}\p{{N}}]') AND x1 + greatest(h, 25) + 10 < x2 THEN greatest(h, 25) + 4 ELSE 0 END AS x1 FROM p""")
def icon_prefixes(spark, d):
    """Lines, a third of them after an icon and a bar, without what is before the bar."""
    x = items(spark, d).withColumn("text", F.when(F.pmod("id", F.lit(3)) == 0, F.concat(F.lit("ic|"), F.col("text"))).otherwise(F.col("text")))
    return layout.icon_prefix(x).select("id", "text", "x1")

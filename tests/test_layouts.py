"""Operators on layouts, tables and jobs, sinks and readers: on small cases with known answers, and against plain Python versions."""

import io
import json
import random
import zipfile
from statistics import median

import pytest
from pyspark.sql import functions as F

from spanwright.functions.colour import Colour, spread_hue
from spanwright.functions.geometry import Box
from spanwright.operators import layout, rules, tables
from spanwright.plans import grids, slides
from spanwright.sinks import documents
from spanwright.sources import readers
from spanwright.streaming import jobs

KEYS = ["page"]
TEXT = "page int, id long, text string, x1 double, y1 double, x2 double, y2 double, size double, bold boolean, align string, color string"
BOX = "page int, cid long, name string, x1 double, y1 double, x2 double, y2 double"


def edges(spark, texts, boxes):
    real = lambda xs: [float(x) if type(x) is int else x for x in xs]
    t = spark.createDataFrame([(1, i, *real(x)) for i, x in enumerate(texts)], TEXT)
    c = spark.createDataFrame([(1, i, f"box{i}", *real(b)) for i, b in enumerate(boxes)], BOX)
    e = layout.style_edges(t, c, KEYS)
    return t, e, {(r["a_id"], r["b_id"]): r["reasons"] for r in e.collect()}


def test_sizes_too_far_apart_make_two_classes(spark):
    row = lambda text, x, y, size: (text, x, y, x + 60, y + 20, size, False, "left", "#222222")
    t, e, got = edges(spark, [row("aa", 20, 20, 20.0), row("bb", 120, 20, 20.0), row("cc", 20, 60, 16.0), row("dd", 120, 60, 16.0)], [(0, 0, 300, 200)])
    assert set(got) == {(0, 1), (2, 3)} and "row" in got[0, 1] and "scope:box0" in got[0, 1] and "same_parent" in got[0, 1]


def test_compact_titles_keep_their_sizes(spark):
    from spanwright.operators.graph import connected_components

    row = lambda text, x, size: (text, x, 20, x + 90, 50, size, True, "left", "#054798")
    t, e, got = edges(spark, [row("Kona", 20, 24.0), row("Redis", 140, 28.0), row("Spark", 260, 24.0), ("the body", 20, 90, 200, 110, 12.0, False, "left", "#222222")], [(0, 0, 400, 200)])
    assert "compact_latin_title" in got[0, 1] and "compact_latin_title" not in got[0, 2]
    c = connected_components(e, "a_id", "b_id").select(F.col("node").alias("id"), "component")
    k = layout.style_classes(t, c, KEYS, edges=e).collect()
    assert len(k) == 1 and k[0]["count"] == 3 and not k[0]["size_unification_eligible"] and k[0]["suggested_size"] is None and k[0]["bold_stable"]
    assert layout.style_classes(t, c, KEYS).count() == 0


def test_alert_bands_of_sibling_cards(spark):
    """Red warnings low in two cards are one class although their widths differ by wrapping; those high up are not."""
    def card(x, y, w, h):
        return ("watch out now", x, y, x + w, y + h, 14.0, True, "left", "#D43E3E")

    cards = [(0, 0, 200, 200), (300, 0, 500, 200)]
    assert "relative_alert_band" in edges(spark, [card(10, 150, 180, 30), card(310, 152, 100, 34)], cards)[2][0, 1]
    assert not edges(spark, [card(10, 20, 180, 30), card(310, 80, 60, 34)], cards)[2]


@pytest.mark.parametrize("box, want", [((915, 213, 962, 221), True), ((980, 193, 1040, 201), False)])
def test_border_connector(spark, box, want):
    b = lambda v: Box(*(F.lit(x) for x in v))
    assert spark.range(1).select(layout.border_connector(b((909, 173, 1227, 225)), b(box))).first()[0] is want


def test_recognised_text_becomes_a_layout(spark, tmp_path):
    items = spark.createDataFrame([(1, 0, "Title", 10, 10, 110, 40), (1, 1, " ", 0, 0, 5, 5), (1, 2, "none", 9, 9, 9, 20), (1, 3, "中文字", 10, 60, 90, 90)], "page int, idx int, text string, x1 int, y1 int, x2 int, y2 int")
    el = layout.text_elements(items, KEYS, ["idx"], F.lit(720))
    assert [(r["name"], r["text"], r["size"]) for r in el.orderBy("name").collect()] == [("t000", "Title", round(30 * 0.75 * 0.78)), ("t001", "中文字", round(30 * 0.75 * 0.85))]
    pages = documents.page_layouts(el, KEYS, ["name"], F.lit(1280), F.lit(720), image=F.lit("bg.png"))
    doc = json.loads(pages.first()["layout"])
    assert [x["type"] for x in doc["elements"]] == ["image", "text", "text"] and doc["elements"][0]["box"] == [0, 0, 1280, 720] and doc["elements"][1]["box"] == [10, 10, 100, 30] and abs(doc["slide_size"]["width_in"] - 13.3333) < 1e-3
    documents.write_documents(pages, "layout", f"{tmp_path}/out", KEYS)
    assert json.loads(spark.read.text(f"{tmp_path}/out").first()["value"]) == doc


def test_layouts_combine(spark, tmp_path):
    one = {"source_width": 100, "source_height": 50, "background": "#000000", "slide_size": {"width_in": 10, "height_in": 5}, "elements": [{"type": "text", "text": "a"}]}
    two = {"slides": [{"elements": [], "background": "#111111"}, {"elements": [{"x": 1}], "name": "own"}], "canvas": {"width": 7, "height": 8}}
    (tmp_path / "page_01.layout.json").write_text("﻿" + json.dumps(one))
    (tmp_path / "page_02.layout.json").write_text(json.dumps(two))
    (tmp_path / "combined.layout.json").write_text(json.dumps(two))
    (tmp_path / "other.json").write_text("{}")
    found = readers.layouts(spark, str(tmp_path))
    assert sorted(r["name"] for r in found.collect()) == ["page_01.layout", "page_02.layout"]
    deck = json.loads(documents.combined_layout(found, "name", "layout").first()["layout"])
    assert (deck["source_width"], deck["background"], deck["slide_size"]) == (100, "#000000", {"width_in": 10, "height_in": 5}) and len(deck["slides"]) == 3
    a, b, c = deck["slides"]
    assert a["elements"] == one["elements"] and a["name"] == "page_01.layout" and b["background"] == "#111111" and b["source_width"] == 7 and c["name"] == "own" and "background" not in c


def test_reviews(spark, tmp_path):
    e = spark.createDataFrame([(1, 0, "a", "red", None), (1, 1, "b", "green", "b"), (2, 0, "c", "yellow", "")], "page int, idx int, original_text string, tier string, corrected_text string")
    p = {r["page"]: json.loads(r["packet"]) for r in documents.review_packets(e, KEYS, ["idx"], 0.95).collect()}
    assert p[1]["tier_counts"] == {"green": 1, "yellow": 0, "red": 1} and [x["corrected_text"] for x in p[1]["entries"]] == [None, "b"] and p[2]["entries"][0]["corrected_text"] == ""
    items = spark.createDataFrame([(1, i, t, 0.5, i, 0, 9, 9) for i, t in enumerate("abcde")], "page int, idx int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    fixes = spark.createDataFrame([(1, 0, "a", "a", 0), (1, 1, "b", "", 1), (1, 2, "c", "new", 2), (1, 3, "d", "x", 99), (1, 4, "e", None, 4)], "page int, idx int, original_text string, corrected_text string, x1 int").withColumns({"y1": F.lit(0), "x2": F.lit(9), "y2": F.lit(9)})
    out = documents.corrected_items(items, fixes, ["page", "idx"])
    assert [tuple(r) for r in out.orderBy("idx").select("outcome", "text", "confidence", "preserve_visual").collect()] == [("confirm", "a", 1.0, None), ("preserve", "", 1.0, True), ("replace", "new", 1.0, None), ("mismatch", "d", 0.5, None), ("skip", "e", 0.5, None)]
    at = [documents.write_version(x, f"{tmp_path}/ocr", first=items) for x in (out, out.limit(1))]
    assert [a.rsplit("/", 1)[1] for a in at] == ["v1", "v2"] and spark.read.parquet(f"{tmp_path}/ocr/v0").count() == 5 and "outcome" not in spark.read.parquet(f"{tmp_path}/ocr/v0").columns


def test_table_candidates():
    cell = lambda x, y, w=80: {"x1": x, "y1": y, "x2": x + w, "y2": y + 20}
    grid = [cell(100 * c + (r % 2), 30 * r) for r in range(4) for c in range(3)]
    assert tables.candidates_of(grid) == [{"x1": 0, "y1": 0, "x2": 287, "y2": 116, "rows": 4, "cols": 3, "cells_used": 12, "density": 1.0}]
    assert tables.candidates_of([]) == [] and tables.candidates_of([cell(37 * r * r % 500, 30 * r) for r in range(8)]) == []
    drift = [cell(100 * c, 30 * r) for r, cols in enumerate([(0, 1, 2), (1, 2, 3), (2, 3), (0, 3), (0, 1), (1, 2)]) for c in cols]
    got = tables.candidates_of(drift, least_density=0.4)
    assert len(got) == 1 and got[0]["rows"] == 6 and got[0]["cols"] == 4  # each row is held against all columns so far


def test_structure_tokens(spark):
    tokens = ["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "<tr>", "<td>", "x", "</td>", "<td></td>", "</tr>"]
    assert tables.cells_of(tokens) == [(0, 0, 2, 1), (0, 1, 1, 1), (0, 2, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1)]
    d = spark.createDataFrame([(7, tokens), (8, None), (9, [])], "t long, tokens array<string>")
    assert [tuple(r) for r in tables.structure_cells(d, "t", "tokens").orderBy("cell").collect()] == [(7, i, *c) for i, c in enumerate(tables.cells_of(tokens))]


def test_boundaries(spark, sf_dir):
    got = {(r["doc_id"], r["slide"]): r["edges"] for r in grids.grid_boundaries(spark, sf_dir).collect()}
    by = {}
    for r in grids.grid(spark, sf_dir).collect():
        by.setdefault((r["doc_id"], r["slide"]), []).append(r)
    for k, rows in by.items():
        samples = [[] for _ in range(5)]
        for r in rows:
            samples[r["col"]].append(r["x1"])
            samples[r["col"] + 1].append(r["x2"])
        want = [sorted(v)[len(v) // 2] if v else round(30 + 1200 * i / 4) for i, v in enumerate(samples)]
        want[0], want[-1] = 30, 1230
        for i in range(1, 5):
            want[i] = want[i - 1] + 5 if want[i] <= want[i - 1] + 4 else want[i]
        assert got[k] == [*want[:-1], 1230]


def test_table_candidates_of_slides(spark, sf_dir):
    by = {}
    for r in slides.items(spark, sf_dir).orderBy("y1", "x1").collect():
        by.setdefault((r["doc_id"], r["slide"]), []).append({k: r[k] for k in ("x1", "y1", "x2", "y2")})
    want = sorted((k, tuple(c.values())) for k, rows in by.items() for c in tables.candidates_of(rows))
    assert sorted(((r["doc_id"], r["slide"]), tuple(r)[2:]) for r in grids.table_candidates(spark, sf_dir).collect()) == want and want


LIFE = [("a", 0, "start", None), ("a", 1, "line", "=== 2/5 clean"), ("a", 2, "line", "page 3: ok"), ("a", 3, "line", "page 2: ok"), ("a", 4, "line", "=== 5/5 end"), ("a", 5, "exit", "0 ok"),
        ("b", 0, "cancel", None), ("b", 1, "start", None), ("b", 2, "retry", None), ("b", 3, "start", None), ("b", 4, "exit", "1"),
        ("c", 0, "start", None), ("c", 1, "cancel", None), ("c", 2, "exit", "0 ok"), ("d", 0, "start", None), ("d", 1, "restart", None), ("e", 0, "start", None), ("e", 1, "exit", "137"), ("f", 0, "start", None), ("f", 1, "exit", "0")]
ENDS = {"a": ("done", 100, 3, None), "b": ("failed", 0, 0, "exit 1"), "c": ("canceled", 0, 0, "cancelled by user"), "d": ("failed", 0, 0, "interrupted by restart"), "e": ("canceled", 0, 0, "cancelled by user"), "f": ("failed", 0, 0, "exit 0")}


def test_job_histories(spark, tmp_path):
    d = spark.createDataFrame(LIFE, "job string, seq long, kind string, value string")
    rows = {(r["job"], r["seq"]): (r["status"], r["progress"], r["page"], r["error"]) for r in jobs.history(d).collect()}
    assert {k: rows[k, max(s for j, s in rows if j == k)] for k in ENDS} == ENDS
    assert rows["a", 4][1] == 95 and rows["b", 1][0] == "canceled" and rows["b", 2] == ("queued", 0, 0, None)
    for i, part in enumerate((LIFE[:9], LIFE[9:])):  # two batches: state lasts
        spark.createDataFrame(part, d.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = jobs.history_stream(s).writeStream.foreachBatch(documents.upsert_batches(f"{tmp_path}/jobs", "job", "seq")).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    last = max((tmp_path / "jobs").iterdir(), key=lambda p: int(p.name[1:]))
    assert {r["job"]: (r["status"], r["progress"], r["page"], r["error"]) for r in spark.read.parquet(str(last)).collect()} == ENDS


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return bytearray(out.getvalue())


def test_archives(spark):
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    files = [("good", archive([("a/b.png", b"12"), ("c.txt", b"")])), ("up", archive([("../x", b"1")])), ("link", archive([(link, b"/etc")])), ("bad", bytearray(b"no zip")), ("many", archive([(f"f{i}", b"x") for i in range(9)]))]
    got = readers.zip_entries(spark.createDataFrame(files, "path string, content binary"), most_entries=8).collect()
    assert {(r["path"], r["entry"], r["size"]) for r in got if r["error"] is None} == {("good", "a/b.png", 2), ("good", "c.txt", 0)}
    assert {r["path"]: r["error"] for r in got if r["error"]} == {"up": "unsafe entry", "link": "link", "bad": "File is not a zip file", "many": "too many entries"}
    slide = "<p:sld><p:sp><a:t>Click to add</a:t></p:sp><p:sp><p:pic/></p:sp><p:sp><a:t>a &amp; b</a:t><a:t></a:t></p:sp></p:sld>"
    deck = readers.zip_entries(spark.createDataFrame([("d", archive([("ppt/slides/slide2.xml", slide), ("ppt/slides/slide1.xml", "<a:t>first</a:t>"), ("ppt/media/i.png", b"")]))], "path string, content binary"))
    r = readers.presentation_texts(deck).first()
    assert (r["slides"], r["media"], r["empty_media"], r["text_boxes"], r["texts"]) == (2, 1, 1, 2, ["first", "Click to add", "a & b"])
    from spanwright.functions import text as tx
    report = readers.presentation_texts(deck).select(documents.quality_report(F.col("slides"), F.col("media"), F.col("empty_media"), F.size("texts"), F.size(F.filter("texts", lambda x: tx.has_placeholder(x))))).first()[0]
    assert json.loads(report)["failures"] == ["PPTX contains 1 zero-byte media.", "PPTX contains 1 placeholder text runs."]


def test_more_readers(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# no\n  Acme \n\nAcme\nZ\n")
    assert sorted(r["text"] for r in readers.whitelist(spark, f"{tmp_path}/w.txt").collect()) == ["Acme", "Z"]
    (tmp_path / "p.icon.json").write_text(json.dumps({"entries": [{"kind": "ocr_item", "bbox": [1, 2, 3, 4], "decision": "icon"}, {"kind": "ocr_item", "bbox": [1, 2, 3, 4], "decision": "text"}, {"kind": "component", "bbox": [0, 0, 1, 1], "decision": "icon"}, {"kind": "ocr_item", "bbox": [9, 9, 9, 9], "decision": None}]}))
    dec = readers.icon_decisions(spark, f"{tmp_path}/*.icon.json").withColumn("page", F.lit(1))
    assert dec.count() == 2
    items = spark.createDataFrame([(1, 1, 2, 3, 4, True), (1, 5, 5, 6, 6, True)], "page int, x1 int, y1 int, x2 int, y2 int, preserve_visual boolean")
    assert [(r["preserve_visual"], r["force_text"]) for r in readers.with_decisions(items, dec, KEYS).orderBy("x1").collect()] == [(None, True), (True, None)]
    sse = spark.createDataFrame([(1, i, x) for i, x in enumerate(['data: {"choices":[{"delta":{"content":" a"}}]}', ": ping", 'data: {"choices":[{"delta":{"content":"b "}}]}', "data: [DONE]"])], "k int, s int, line string")
    assert readers.sse_text(sse, "k", "s", "line").first()["text"] == "ab"
    v = spark.createDataFrame([('{"a": [{"text": "x\\"y"}, {"b": {"text": "z", "t": 1}}], "text": 5}',)], "v string")
    assert v.select(readers.json_texts(F.col("v"))).first()[0] == ['x"y', "z"]
    kinds = spark.createDataFrame([(0, 1), (1, 0), (3, 0), (1, 1), (0, 2)], "i int, p int").select(readers.source_kind(F.col("i"), F.col("p"))).collect()
    assert [r[0] for r in kinds] == ["pdf", "image", "dir", None, None]


def test_scores_and_status(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    r = spark.range(1).select(rules.composite_score(*lit(True, 0.9593, 1.0, 1.0, 0.212, True, True)), rules.composite_score(*lit(True, 0.9, 0.8, 0.5), F.lit(None).cast("double"), *lit(True, False)), rules.composite_score(*lit(False, 1.0, 1.0, 1.0, 0.0, True, True))).first()
    assert tuple(r) == (0.9454, 0.65, 0.0)  # the first is a published score
    names = list(rules.TOLERANCES)
    status = lambda now, base, known=True, failed=False: spark.range(1).select(rules.regression(dict(zip(names, lit(*now))), dict(zip(names, lit(*base))), F.lit(known), F.lit(failed))).first()[0]
    assert status((.9,) * 4, (.9,) * 4) == "UNCHANGED" and status((.9, .9, .9, .8), (.8, .9, .9, .9)) == "REGRESSED" and status((.9, .9, .92, .9), (.9,) * 4) == "UNCHANGED"
    assert status((.92, .9, .9, .9), (.9,) * 4) == "IMPROVED" and status((.9,) * 4, (.9,) * 4, False) == "NEW" and status((.9,) * 4, (.9,) * 4, True, True) == "FAILED"


def test_colours(spark):
    import colorsys

    d = spark.createDataFrame([("#D43E3E",), ("054798",), ("#FFF",), ("  #222222 ",), (None,)], "c string")
    c = Colour.parse(F.col("c"))
    assert [(r[0], r[1]) for r in d.select(c.family, c.hex).collect()][:2] == [("red", "#D43E3E"), ("blue", "#054798")]
    assert [r[0] for r in d.select(c.family).collect()] == ["red", "blue", "unknown", "black", "unknown"]
    got = [r[0] for r in spark.range(60).select(spread_hue(F.lit(3), F.col("id"))).collect()]
    want = ["#%02X%02X%02X" % tuple(round(v * 255) for v in colorsys.hsv_to_rgb((0.137 + 3 * 0.173 + i * 0.61803398875) % 1.0, 0.92, 0.50)) for i in range(60)]
    assert got == want


def test_rows_by_running_mean():
    rnd = random.Random(3)
    items = [{"x1": 0, "x2": 5, "y1": (y := rnd.randrange(200)), "y2": y + rnd.randrange(6, 20)} for _ in range(60)]
    tolerance, rows = max(8.0, 0.6 * median(r["y2"] - r["y1"] for r in items)), []
    for r in sorted(items, key=lambda r: (r["y1"] + r["y2"]) / 2):
        y = (r["y1"] + r["y2"]) / 2
        if rows and abs(y - sum((q["y1"] + q["y2"]) / 2 for q in rows[-1]) / len(rows[-1])) <= tolerance:
            rows[-1].append(r)
        else:
            rows.append([r])
    assert tables._rows(items) == rows


def test_passes_over_a_slide(spark, sf_dir):
    from spanwright.operators import folds

    t = lambda text, size, y=0, bold=False, color="#222222", x=0: {"text": text, "size": size, "x1": x, "x2": x + 40, "y1": y, "y2": y + 20, "bold": bold, "color": color}
    assert folds.unified([t("524", 12), t("63", 18), t("ab", 20), t("long text", 12), t("cd", 12, y=100), t("ef", 12, bold=True)]) == [12, 12, 20, 12, 12, 12]  # 20 would make the cluster span 1.67
    assert folds.groups([t("10%", 12), t("ab", 12), t("20%", 9, color="#302020"), t("cd", 12, color="#D43E3E"), t("中", 12), t("de", 12)]) == [0, 1, 0, 2, 3, 1]
    assert folds.majority_bold([t("a", 1, bold=True), t("b", 1), t("c", 1), t("d", 1, bold=True)], [0, 0, 1, 2]) == [True, True, False, True]
    assert folds.colours([t("a", 1), t("b", 1, x=50), t("c", 1, x=900)]) == [0, 1, 0] and folds.colours([t("a", 1)] * 14).count(-1) == 2
    got = slides.slide_folds(spark, sf_dir).collect()
    assert len(got) == slides.items(spark, sf_dir).count() and all(r["unified_size"] <= r["size"] for r in got)


def test_groups_across_batches(spark):
    """Passes over groups that batches cut, and over none; the slides are read in batches, without a frame for each."""
    from spanwright.operators import folds, groups

    d = spark.createDataFrame([(k, i, f"t{k}") for k in range(40) for i in range(1 + k % 9)], "k long, i long, name string").repartition(3)
    step = lambda rows: [(len(rows), [r["i"] for r in rows] == list(range(len(rows)))) for _ in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = groups.folded(d, ["k"], ["i"], step, "n long, ok boolean").collect()
        few = groups.mapped(d, ["k"], ["i"], lambda rows: [(rows[0]["k"], len(rows))] if len(rows) > 5 else [], "k long, n int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == d.count() and all(r["n"] == 1 + r["k"] % 9 and r["ok"] and r["name"] == f"t{r['k']}" for r in got)
    assert sorted(tuple(r) for r in few) == [(k, 1 + k % 9) for k in range(40) if k % 9 > 4]
    assert groups.folded(d.limit(0), ["k"], ["i"], step, "n long, ok boolean").count() == 0
    for out in (tables.detect(d.selectExpr("k as page", "i as x1", "i as y1", "i as x2", "i as y2"), ["page"]), folds.folded(d.selectExpr("k", "i", "name as text", "i as x1", "i as y1", "i as x2", "i as y2", "i as size", "true as bold", "name as color"), ["k"], "i")):
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_components_within_slides(spark):
    """As connected_components says, in one pass."""
    from spanwright.operators import graph

    rnd = random.Random(4)
    e = spark.createDataFrame([(k, k * 100 + rnd.randrange(24), k * 100 + rnd.randrange(24)) for k in range(20) for _ in range(12)], "page long, a long, b long")
    assert sorted(map(tuple, graph.components_within(e, ["page"], "a", "b").collect())) == sorted(map(tuple, graph.connected_components(e, "a", "b").collect()))

"""Sources. Each is a DataFrame reader; what cannot be read becomes a row that says so, not a lost file."""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of page images.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
OCR_ITEM = "text string, x1 double, y1 double, x2 double, y2 double, confidence double, words array<string>, chars array<string>"
#: Leading bytes, as hexadecimal, by kind of file.
MAGIC = {"png": "^89504E470D0A1A0A", "jpg": "^FFD8FF", "pdf": "^25504446", "webp": "^52494646.{8}57454250", "zip": "^504B0304", "gif": "^474946"}


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """page, path, length of the files page_<number>.<image extension>. A page with two files is an error when read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"(?i)/page_(\d+)\.(" + "|".join(IMAGES) + ")$", 1)
    found = files.withColumn("number", F.when(name != "", name).try_cast("int")).filter("number is not null")
    one = found.groupBy("number").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("length").alias("length"))
    path = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two files of page "), F.col("number").cast("string")))).otherwise(F.col("path"))
    return one.select(F.format_string("%02d", "number").alias("page"), "number", path.alias("path"), "length")


def renumbered(files: DataFrame) -> DataFrame:
    """Files in order of path as pages from 01. A folder's files are few, so one window holds them."""
    from pyspark.sql import Window

    return files.withColumn("page", F.format_string("page_%02d", F.row_number().over(Window.orderBy("path"))))


def kind_of(content: Column) -> Column:
    """The kind of file by its leading bytes, or null."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        out = F.when(head.rlike(magic), kind).otherwise(out)
    return out


def ocr_items(spark: SparkSession, glob: str) -> DataFrame:
    """Recognised text of files that hold a list, or an object with items, results or ocr. Blank text, values that are no numbers and
    empty boxes are left out; a missing confidence counts as 1."""
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    raw = raw.filter(~F.col("file").endswith(".raw.json"))
    item = f"array<struct<{OCR_ITEM.replace(' ', ':').replace(',:', ',')}>>"
    parts = F.coalesce(F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", item)), *(F.from_json(F.get_json_object("value", f"$.{k}"), item) for k in ("items", "results", "ocr")))
    page = F.regexp_extract("file", r"page_(\d+)", 1)
    rows = raw.select(page.alias("page"), F.posexplode(parts).alias("idx", "x")).select("page", "idx", "x.*")
    return rows.filter((F.trim("text") != "") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def repaired_json(value: Column) -> Column:
    """JSON text out of a reply: without a code fence or what is around the outer braces, then with trailing commas removed; null if
    neither reads as JSON."""
    body = F.regexp_extract(value, r"(?s)(\{.*\}|\[.*\])", 1)
    fixed = F.regexp_replace(body, r",(\s*[}\]])", "$1")
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull() & (x != ""), x)
    return F.coalesce(ok(body), ok(fixed))


def log_progress(lines: DataFrame) -> DataFrame:
    """stage, stages and page of log lines such as '=== 2/5 name' and 'page 3: ...'; works for tables and streams."""
    x = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit("")).try_cast("int")
    return lines.withColumns({"stage": x(r"^===\s*(\d+)/(\d+)\s+", 1), "stages": x(r"^===\s*(\d+)/(\d+)\s+", 2), "page": x(r"^page\s+(\d+):", 1)})


def sse_text(lines: DataFrame, key: str, seq: str, line: str) -> DataFrame:
    """Text of a stream of 'data: {json}' lines, joined in order by key; what is no such line adds nothing."""
    data = F.get_json_object(F.regexp_extract(line, r"^data:\s*(\{.*\})\s*$", 1), "$.choices[0].delta.content")
    d = lines.select(key, seq, data.alias("part")).filter("part is not null")
    return d.groupBy(key).agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq, "part"))), lambda x: x["part"]), "")).alias("text"))


def layouts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, layout) of the layout files of a folder: page_*.layout.json if there are any, else all JSON files; never a combined deck. A mark of byte order is left out."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("layout"))
    raw = raw.filter(~F.col("file").startswith("combined."))
    page = F.col("file").rlike(r"^page_.*\.layout\.json$")
    pages = raw.filter(page)
    return (raw if pages.isEmpty() else pages).select(F.regexp_replace("file", r"\.json$", "").alias("name"), "layout")


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(text): trimmed lines of a file, without blank ones and comments."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).filter("text <> '' and not startswith(text, '#')").distinct()


def icon_decisions(spark: SparkSession, glob: str) -> DataFrame:
    """(file, kind, x1, y1, x2, y2, decision) of reviews, decided ones only; of equal boxes the last wins."""
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "entries array<struct<kind:string,bbox:array<int>,decision:string>>").alias("d"))
    e = raw.select("file", F.posexplode("d.entries").alias("at", "e")).filter("e.decision in ('icon', 'text')")
    box = [F.get("e.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]
    return e.select("file", "at", "e.kind", *box, "e.decision").groupBy("file", "kind", "x1", "y1", "x2", "y2").agg(F.max_by("decision", "at").alias("decision"))


def with_decisions(items: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """items with force_text or preserve_visual set where a decision on their very box says so; the other flag is taken back."""
    box = ["x1", "y1", "x2", "y2"]
    d = items.join(decisions.filter("kind = 'ocr_item'").select(*keys, *box, "decision"), [*keys, *box], "left")
    old = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("boolean")
    icon, text = F.col("decision") == "icon", F.col("decision") == "text"
    return d.withColumns({"preserve_visual": F.when(icon, True).when(text, None).otherwise(old("preserve_visual")), "force_text": F.when(text, True).when(icon, None).otherwise(old("force_text"))}).drop("decision")


def source_kind(images: Column, pdfs: Column) -> Column:
    """What an upload of so many images and PDF files is, or null if it is nothing that can be converted."""
    return F.when((pdfs == 1) & (images == 0), "pdf").when((images == 1) & (pdfs == 0), "image").when((images > 0) & (pdfs == 0), "dir")


#: Entries and bytes that an archive may hold.
MOST_ENTRIES, MOST_BYTES = 1000, 1 << 30
ENTRY = "path string, entry string, size long, content binary, error string"


def zip_entries(files: DataFrame, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The files in archives (path, content). An archive that is damaged, too large, or has an entry with an unsafe name or a link gives one row with
    its error and no content."""
    def entries(path: str, content: bytes) -> list[tuple]:
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            return [(path, None, None, None, str(e))]
        infos = z.infolist()
        if len(infos) > most_entries:
            return [(path, None, None, None, "too many entries")]
        if sum(i.file_size for i in infos) > most_bytes:
            return [(path, None, None, None, "too large")]
        out, left = [], most_bytes
        for i in infos:
            name = i.filename
            if not name or name.endswith("/"):
                continue
            if "\\" in name or name.startswith("/") or ":" in name or any(p in ("..", "") for p in name.split("/")):
                return [(path, name, None, None, "unsafe entry")]
            if stat.S_ISLNK(i.external_attr >> 16):
                return [(path, name, None, None, "link")]
            try:
                with z.open(i) as f:
                    data = f.read(left + 1)
            except (zipfile.BadZipFile, OSError, RuntimeError) as e:
                return [(path, name, None, None, str(e))]
            left -= len(data)
            if left < 0:
                return [(path, None, None, None, "too large")]
            out.append((path, name, len(data), data, None))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(entries(path, bytes(content)), columns=["path", "entry", "size", "content", "error"])

    return files.select("path", "content").mapInPandas(run, ENTRY)


def presentation_texts(entries: DataFrame) -> DataFrame:
    """(path, slides, media, empty_media, text_boxes, texts) of presentation packages, from their entries: runs of text in order of slide and place."""
    slide = F.col("entry").rlike(r"^ppt/slides/slide.*\.xml$")
    media = F.col("entry").startswith("ppt/media/")
    xml = F.col("content").cast("string")
    runs = F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<a:t(?:\s[^>]*)?>(.*?)</a:t>"), F.lit(1)), _unescaped), lambda t: t != "")
    boxes = F.size(F.filter(F.regexp_extract_all(xml, F.lit(r"(?s)<p:sp[ >].*?</p:sp>"), F.lit(0)), lambda x: x.rlike("<a:t[ >/]")))
    d = entries.filter("error is null").select("path", "entry", "size", slide.alias("slide"), media.alias("media"), F.when(slide, runs).alias("runs"), F.when(slide, boxes).alias("boxes"))
    g = d.groupBy("path").agg(F.count_if("slide").alias("slides"), F.count_if("media").alias("media"), F.count_if(F.col("media") & (F.col("size") == 0)).alias("empty_media"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("text_boxes"),
                              F.sort_array(F.collect_list(F.when(F.col("slide"), F.struct("entry", "runs")))).alias("x"))
    return g.select("path", "slides", "media", "empty_media", "text_boxes", F.flatten(F.transform("x", lambda s: s["runs"])).alias("texts"))


def _unescaped(t: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def json_texts(value: Column) -> Column:
    """Every string under a key text, at any depth, in order; an escaped quote stays part of it."""
    found = F.regexp_extract_all(value, F.lit(r'"text"\s*:\s*("(?:[^"\\]|\\.)*+")'), F.lit(1))
    return F.transform(found, lambda x: F.get_json_object(F.concat(F.lit('{"t":'), x, F.lit("}")), "$.t"))

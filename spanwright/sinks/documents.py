"""Documents as JSON lines or one JSON file a key, and snapshots of tables. What is written is never what is being read: a new version goes to a folder of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Header of a deck whose first layout does not say.
SLIDE_SIZE, WIDTH, HEIGHT, BACKGROUND = (13.333333, 7.5), 1182, 665, "#FFFFFF"


def page_layouts(elements: DataFrame, keys: list[str], order: list[str], width: Column, height: Column, slide_h_in: float = 7.5, image: Column | None = None) -> DataFrame:
    """(keys, layout): a page's layout with its elements in order, its image first. elements: type, name, text, x, y, w, h, size, font, bold, color, align."""
    w, h = width.cast("long"), height.cast("long")
    el = F.struct("type", "name", "text", F.array("x", "y", "w", "h").alias("box"), "font", "size", "bold", "color", "align")
    texts = F.transform(F.sort_array(F.collect_list(F.struct(*order, el.alias("el")))), lambda x: x["el"])
    g = elements.groupBy(*keys).agg(texts.alias("texts"), F.first(w).alias("w"), F.first(h).alias("h"), F.first(image if image is not None else F.lit(None).cast("string")).alias("image"))
    size = F.struct((slide_h_in * F.col("w") / F.greatest(F.lit(1), F.col("h"))).alias("width_in"), F.lit(slide_h_in).alias("height_in"))
    ground = F.struct(F.lit("image").alias("type"), F.lit("bg").alias("name"), F.col("image").alias("path"), F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), "w", "h").alias("box"), F.lit("background").alias("role"))
    parts = F.concat_ws(",", F.when(F.col("image").isNotNull(), F.to_json(ground)), F.array_join(F.transform("texts", lambda x: F.to_json(x)), ","))
    head = F.to_json(F.struct(size.alias("slide_size"), F.col("w").alias("source_width"), F.col("h").alias("source_height"), F.lit(BACKGROUND).alias("background")))
    return g.select(*keys, F.concat(F.left(head, F.length(head) - 1), F.lit(',"elements":['), parts, F.lit("]}")).alias("layout"))


def combined_layout(layouts: DataFrame, name: str, layout: str) -> DataFrame:
    """(layout): one deck of all layouts in order of name. Its header is that of the first; slides inherit what their own document says, and are named by it. A document's
    slides come in their order."""
    get = lambda k: F.get_json_object(layout, f"$.{k}")
    own = {k: F.coalesce(get(k), get(c)) for k, c in {"source_width": "canvas.width", "source_height": "canvas.height", "slide_size": "slide_size", "background": "background"}.items()}
    quoted = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), F.when(v.rlike(r"^[\[{0-9-]"), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))))
    d = layouts.withColumns({f"__{k}": v for k, v in own.items()}).withColumn("__slides", F.from_json(get("slides"), "array<string>"))
    plain = F.array(F.concat(F.lit('{"elements":'), F.coalesce(get("elements"), F.lit("[]")), F.lit("}")))
    d = d.select(F.col(name).alias("name"), F.posexplode(F.when(F.size("__slides") > 0, F.col("__slides")).otherwise(plain)).alias("at", "slide"), *(f"__{k}" for k in own))
    missing = F.concat_ws(",", *(F.when(F.get_json_object("slide", f"$.{k}").isNull(), quoted(k, F.col(f"__{k}"))) for k in own), F.when(F.get_json_object("slide", "$.name").isNull(), F.concat(F.lit('"name":"'), F.col("name"), F.lit('"'))))
    full = F.concat(F.left("slide", F.length("slide") - 1), F.when(missing != "", F.concat(F.lit(","), missing)).otherwise(""), F.lit("}"))
    d = d.withColumn("slide", full)
    g = d.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "at", "slide"))), lambda x: x["slide"]), ",").alias("slides"), *(F.min_by(f"__{k}", F.struct("name", "at")).alias(k) for k in own))
    either = lambda k, v: F.coalesce(F.col(k), F.lit(v))
    head = F.concat_ws(",", quoted("slide_size", either("slide_size", '{"width_in":%s,"height_in":%s}' % SLIDE_SIZE)), quoted("source_width", either("source_width", str(WIDTH))), quoted("source_height", either("source_height", str(HEIGHT))), quoted("background", either("background", BACKGROUND)))
    return g.select(F.concat(F.lit("{"), head, F.lit(',"slides":['), "slides", F.lit("]}")).alias("layout"))


def write_documents(df: DataFrame, column: str, to: str, by: list[str] | None = None) -> None:
    """One line of text a document, in a folder a key where by is given. Tasks write in parallel; nothing is collected."""
    w = df.select(*(by or []), column).write.mode("overwrite").option("compression", "none")
    (w.partitionBy(*by) if by else w).text(to)


def review_packets(entries: DataFrame, keys: list[str], order: list[str], threshold: float) -> DataFrame:
    """(keys, packet): a page's review with its counts by tier and its entries in order. entries: tier and what else an entry has."""
    fields = [c for c in entries.columns if c not in keys]
    count = lambda t: F.count_if(F.col("tier") == t).alias(t)
    g = entries.groupBy(*keys).agg(*(count(t) for t in ("green", "yellow", "red")), F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("entries"))
    return g.select(*keys, F.to_json(F.struct(F.lit(threshold).alias("threshold"), F.struct("green", "yellow", "red").alias("tier_counts"), "entries"), {"ignoreNullFields": "false"}).alias("packet"))


def corrected_items(items: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """items with outcome, and text, confidence and preserve_visual after a review: an entry counts for the item of its key if their boxes are equal (else mismatch). keys: page and index.
    entries: corrected_text, original_text and the box."""
    box = ("x1", "y1", "x2", "y2")
    e = entries.select(*keys, F.lit(True).alias("__has"), F.col("corrected_text").alias("__fix"), F.col("original_text").alias("__was"), *(F.col(c).alias(f"__{c}") for c in box))
    d = items.join(e, keys, "left")
    same = F.lit(True)
    for c in box:
        same &= F.col(c) == F.col(f"__{c}")
    fix = F.col("__fix")
    out = F.when(F.col("__has").isNull(), "none").when(fix.isNull(), "skip").when(~same, "mismatch").when(fix == F.col("__was"), "confirm").when(fix == "", "preserve").otherwise("replace")
    d = d.withColumn("outcome", out)
    done = F.col("outcome").isin("confirm", "preserve", "replace")
    was = F.col("preserve_visual") if "preserve_visual" in items.columns else F.lit(None).cast("boolean")
    return d.withColumns({"text": F.when(F.col("outcome").isin("preserve", "replace"), fix).otherwise(F.col("text")), "confidence": F.when(done, 1.0).otherwise(F.col("confidence")), "preserve_visual": F.when(F.col("outcome") == "preserve", True).when(done, None).otherwise(was)}).drop("__has", "__fix", "__was", *(f"__{c}" for c in box))


def write_version(df: DataFrame, folder: str, first: DataFrame | None = None) -> str:
    """df as the next version of a table below folder; the first version holds what there was before any correction and is never written again."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    known = sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(fs_path)) if fs.exists(fs_path) else []
    if not known and first is not None:
        first.write.parquet(f"{folder}/v0")
        known = [0]
    to = f"{folder}/v{known[-1] + 1 if known else 0}"
    df.write.parquet(to)
    return to


def quality_report(slides: Column, media: Column, empty_media: Column, runs: Column, placeholders: Column) -> Column:
    """A report's JSON with what failed."""
    failures = F.array_compact(F.array(F.when(slides == 0, "PPTX contains no slides."), F.when(empty_media > 0, F.format_string("PPTX contains %d zero-byte media.", empty_media)), F.when(placeholders > 0, F.format_string("PPTX contains %d placeholder text runs.", placeholders))))
    return F.to_json(F.struct((F.size(failures) == 0).alias("ok"), slides.alias("slide_count"), media.alias("media_count"), runs.alias("text_run_count"), placeholders.alias("placeholder_count"), empty_media.alias("zero_byte_media"), failures.alias("failures")))


def latest(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Upsert: of each key the row of the highest seq, new rows before old ones of the same."""
    rows = [c for c in old.columns if c != key]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*rows), F.struct(F.col(seq), F.col("__new"))).alias("r")).select(key, "r.*")


def upsert_batches(folder: str, key: str, seq: str):
    """For foreachBatch: each batch makes the next version of the table in folder. A batch that is run again leaves the same table."""
    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        known = sorted((int(x.getPath().getName()[1:]) for x in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
        old = spark.read.parquet(f"{folder}/v{known[0]}") if known else batch.limit(0)
        latest(old, batch, key, seq).write.parquet(f"{folder}/v{known[0] + 1 if known else 0}")

    return run


def visible_to(events: DataFrame, users: DataFrame, owner: str) -> DataFrame:
    """(user_id, event columns): what each user may see: all for an admin, their own otherwise. users: user_id and is_admin. Owners join by key; only admins, who are few, see all."""
    own = events.join(users.filter("not is_admin").select(F.col("user_id").alias(owner)), owner).select(F.col(owner).alias("user_id"), *events.columns)
    admins = users.filter("is_admin").agg(F.collect_list("user_id").alias("__a")).withColumn("__one", F.lit(1))
    every = events.withColumn("__one", F.lit(1)).join(F.broadcast(admins), "__one").select(F.explode("__a").alias("user_id"), *events.columns)
    return own.unionByName(every)


def visible_counts(counts: DataFrame, users: DataFrame, owner: str) -> DataFrame:
    """(user_id, n, first_id, last_id) of what each user may see, as visible_to says, from counts by owner: an admin's are those of all together, so that no row is made
    for each pair of an admin and an event. A user listed more than once counts as often."""
    u = users.groupBy("user_id").agg(F.count_if("is_admin").alias("__all"), F.count_if(~F.col("is_admin")).alias("__own"))
    every = counts.agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")).filter("n > 0")
    own = u.filter("__own > 0").join(counts.withColumnRenamed(owner, "user_id"), "user_id").select("user_id", (F.col("n") * F.col("__own")).alias("n"), "first_id", "last_id")
    return own.unionByName(u.filter("__all > 0").crossJoin(F.broadcast(every)).select("user_id", (F.col("n") * F.col("__all")).alias("n"), "first_id", "last_id"))

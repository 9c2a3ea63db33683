"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, joins, windows
from ..session import table
from .registry import query


def lines(spark, d, *extra):
    """A row for each line: doc_id, extra columns, its index, and the line trimmed."""
    docs = table(spark, d, "documents").select("doc_id", *extra, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "raw"))
    return docs.withColumn("line", F.btrim("raw", F.lit(tx.WHITE))).drop("raw")


LINES = r"""lines AS (SELECT doc_id, lang, source, n_chars, unnest(range(0, len(l))) AS idx, regexp_replace(unnest(l), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
 FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""


@query(rf"""WITH {LINES}, n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source),
g AS (SELECT source, line, count(DISTINCT doc_id) AS docs, count(*) AS hits, min(idx) AS lo, max(idx) AS hi, list_sort(list(idx)) AS ids FROM lines WHERE line <> '' AND length(line) + length(regexp_replace(line, '[^\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7A3}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) <= 20 GROUP BY source, line)
SELECT g.source, line, docs, hits, CAST(floor((ids[(hits + 1) // 2] + ids[hits // 2 + 1]) / 2.0) AS BIGINT) AS median_idx
FROM g JOIN n USING (source) WHERE docs >= greatest(2, round_even(0.02 * n.n, 0)) AND hi - lo <= 30""")
def template_repeat(spark, d):
    """Lines that many documents of a source have at about the same place."""
    n = table(spark, d, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("total"))
    short = lines(spark, d, "source").filter((F.col("line") != "") & (tx.weighted_length(F.col("line")) <= 20))
    # by document first, so a line of all documents arrives as one row a document
    g = short.groupBy("source", "line").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("hits"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.percentile("idx", 0.5).alias("m"))
    g = g.filter((F.col("docs") >= 2) & (F.col("hi") - F.col("lo") <= 30)).join(n, "source")
    return g.filter(F.col("docs") >= F.greatest(F.lit(2), F.bround(0.02 * F.col("total")))).select("source", "line", "docs", "hits", F.floor("m").alias("median_idx"))


@query(f"""WITH {LINES} SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS hits, min(idx) AS first_idx, max(idx) - min(idx) AS idx_range FROM lines WHERE length(line) > 0 GROUP BY line HAVING count(DISTINCT doc_id) >= 2""")
def repeat_candidates(spark, d):
    g = lines(spark, d).filter("line <> ''").groupBy("line", "doc_id").agg(F.count("*").alias("c"), F.min("idx").cast("long").alias("lo"), F.max("idx").cast("long").alias("hi"))
    g = g.groupBy("line").agg(F.count("*").alias("docs"), F.sum("c").alias("hits"), F.min("lo").alias("first_idx"), (F.max("hi") - F.min("lo")).alias("idx_range"))
    return g.filter("docs >= 2")


@query(f"""WITH {LINES}, r AS (SELECT CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^[0-9]{{1,3}}$') THEN 'page_number' WHEN length(line) <= 4 AND NOT regexp_matches(line, '[A-Za-z0-9]') THEN 'symbols'
 WHEN regexp_matches(line, '^[-=_*>|]+$') THEN 'rule' WHEN length(line) <= 8 THEN 'short' WHEN regexp_matches(line, '^[^a-z]*$') THEN 'shouting' ELSE 'keep' END AS rule, length(line) AS n FROM lines)
SELECT rule, count(*) AS n_lines, sum(n)::BIGINT AS n_chars FROM r GROUP BY rule""")
def noise_rules(spark, d):
    """Each line's first matching noise rule, counted."""
    x = F.col("line")
    rule = (F.when(x == "", "blank").when(x.rlike("^[0-9]{1,3}$"), "page_number").when((F.length(x) <= 4) & ~x.rlike("[A-Za-z0-9]"), "symbols").when(x.rlike(r"^[-=_*>|]+$"), "rule")
            .when(F.length(x) <= 8, "short").when(x.rlike(r"^[^a-z]*$"), "shouting").otherwise("keep"))
    return lines(spark, d).select(rule.alias("rule"), F.length(x).alias("n")).groupBy("rule").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_chars"))


@query("""SELECT outcome, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM (SELECT n_chars, CASE WHEN q IS NULL THEN 'skip' WHEN q = lang THEN 'confirm' WHEN q = '' THEN 'preserve' ELSE 'replace' END AS outcome
 FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN 'en' ELSE 'xx' END AS q FROM labels) l USING (doc_id)) GROUP BY outcome""")
def merge_correction(spark, d):
    """A review's corrections merged in: labels stand in for reviews of the language."""
    fixes = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "").when(F.col("quality") == 1, "en").otherwise("xx").alias("fix"))
    out = joins.correct(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), fixes, ["doc_id"], "lang", "fix")
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query(f"""WITH {LINES}, w AS (SELECT DISTINCT line FROM lines WHERE line <> '' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT doc_id, count(*) AS hits FROM lines WHERE line IN (SELECT line FROM w) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id""")
def whitelist_semi(spark, d):
    """Lines of other documents that are exactly a line of a document of good quality."""
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    x = lines(spark, d).filter("line <> ''")
    white = x.join(good, "doc_id", "left_semi").select("line").distinct()
    return x.join(good, "doc_id", "left_anti").join(white, "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))


@query(r"""WITH p AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[\x20\x09-\x0D]+')) AS word FROM benchmark), k AS (SELECT word FROM p WHERE word <> ''),
w AS (SELECT DISTINCT lang, unnest(string_split_regex(lower(text), '[\x20\x09-\x0D]+')) AS word FROM documents)
SELECT l.lang, count(k.word) AS n_keywords, count(w.word) AS n_found, round(count(w.word) / greatest(count(k.word), 1), 6) AS recall FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN k ON true LEFT JOIN w ON w.lang IS NOT DISTINCT FROM l.lang AND w.word = k.word GROUP BY l.lang""")
def keyword_recall(spark, d):
    """The share of the benchmark's words that the documents of a language have; 0 of no words."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    keys = table(spark, d, "benchmark").select(F.explode(split("text")).alias("word")).distinct()
    n = keys.count()
    docs = table(spark, d, "documents")
    found = docs.select("lang", F.explode(split("text")).alias("word")).join(keys, "word", "left_semi").distinct()
    f = found.groupBy("lang").agg(F.count("*").alias("n_found"))
    langs = docs.select("lang").distinct()
    return langs.join(f, langs["lang"].eqNullSafe(f["lang"]), "left").select(langs["lang"], F.lit(n).cast("long").alias("n_keywords"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.round(F.coalesce("n_found", F.lit(0)) / F.lit(max(n, 1)), 6).alias("recall"))


@query()
def cer_adjacent(spark, d):
    """Edits from the turn before, per character. Engines count edits of text beyond ASCII differently, so it has no SQL."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"), F.lag("text").over(w).alias("p"))
    return c.filter("t is not null and p is not null").select("conv_id", "turn", F.round(tx.cer(F.col("t"), F.col("p")), 6).alias("cer"))


@query(r"""SELECT conv_id, turn, len(x) AS n_distinct, len(list_filter(x, lambda c: NOT list_contains(y, c))) AS n_extra, round(len(list_filter(x, lambda c: NOT list_contains(y, c))) / greatest(len(x), 1), 6) AS extra_ratio FROM
 (SELECT conv_id, turn, list_distinct(string_split(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'), '')) AS x, list_distinct(string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '')) AS y FROM conversations WHERE text <> '') WHERE y IS NOT NULL AND len(x) > 0""")
def extra_ratio(spark, d):
    """The share of a turn's different characters that the turn before lacks."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, d, "conversations").filter("text <> ''").select("conv_id", "turn", F.array_distinct(F.split(F.regexp_replace("text", r"[\x20\x09-\x0D]", ""), "")).alias("x"), F.array_distinct(F.split(F.lag("text").over(w), "")).alias("y"))
    c = c.withColumn("x", F.array_remove("x", "")).filter(F.col("y").isNotNull() & (F.size("x") > 0))
    n = F.size(F.array_except("x", "y"))
    return c.select("conv_id", "turn", F.size("x").cast("long").alias("n_distinct"), n.cast("long").alias("n_extra"), F.round(n / F.size("x"), 6).alias("extra_ratio"))


@query(r"""SELECT lang, bucket, count(*) AS n_lines, sum(n)::BIGINT AS visible, sum(w)::BIGINT AS weighted FROM (SELECT lang, n, w, CASE WHEN len <= 4 THEN 'short' WHEN len <= 12 THEN 'medium' ELSE 'long' END AS bucket FROM
 (SELECT lang, length(line) AS len, length(regexp_replace(line, '[\x20\x09-\x0D\x{00A0}\x{3000}]', '', 'g')) AS n, length(line) + length(regexp_replace(line, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}\x{FF00}-\x{FFEF}]', '', 'g')) AS w
  FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents))) GROUP BY lang, bucket""")
def script_profile(spark, d):
    x = F.col("line")
    docs = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return docs.select("lang", tx.length_bucket(x).alias("bucket"), tx.visible_length(x).alias("n"), tx.weighted_length(x).alias("w")).groupBy("lang", "bucket").agg(F.count("*").alias("n_lines"), F.sum("n").alias("visible"), F.sum("w").alias("weighted"))


@query(f"""WITH {LINES}, k AS (SELECT *, lower(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS norm FROM lines WHERE regexp_matches(line, '^[\\x00-\\x7F]+$')),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id, idx) AS rn, count(*) OVER (PARTITION BY norm) AS votes FROM k WHERE norm <> '')
SELECT norm, votes, line AS best, doc_id FROM r WHERE rn = 1 AND votes >= 2""")
def norm_majority(spark, d):
    """Lines equal once white space and case are gone: how many, and the text of the best."""
    k = lines(spark, d, "n_chars").filter(F.col("line").rlike(r"^[\x00-\x7F]+$")).withColumn("norm", F.lower(F.regexp_replace("line", r"[\x20\x09-\x0D]", ""))).filter("norm <> ''")
    best = F.max_by(F.struct("line", "doc_id"), F.struct("n_chars", -F.col("doc_id"), -F.col("idx"))).alias("b")
    return k.groupBy("norm").agg(F.count("*").alias("votes"), best).filter("votes >= 2").select("norm", "votes", F.col("b.line").alias("best"), F.col("b.doc_id").alias("doc_id"))


@query(f"""WITH RECURSIVE {LINES}, s AS (SELECT DISTINCT doc_id, line FROM lines WHERE length(line) >= 40), o AS (SELECT line, min(doc_id) AS a FROM s GROUP BY line),
e AS (SELECT DISTINCT o.a, s.doc_id AS b FROM s JOIN o USING (line) WHERE o.a < s.doc_id), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM x UNION SELECT x.b, r.seen FROM r JOIN x ON r.node = x.a)
SELECT node AS doc_id, min(seen) AS component FROM r GROUP BY node""")
def components_lines(spark, d):
    """Documents that share a long line, directly or through others. A line gives a star of links, not all pairs."""
    s = lines(spark, d).filter(F.length("line") >= 40).select("doc_id", "line").distinct()
    hub = s.groupBy("line").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    e = s.join(hub, "line").filter("doc_id > a").select("a", F.col("doc_id").alias("b"))
    return graph.connected_components(e, "a", "b").select(F.col("node").alias("doc_id"), "component")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE n_chars IS NULL) AS n_null, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphans(spark, d):
    o = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("n_chars").isNull()).alias("n_null"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("""WITH m AS (SELECT source, doc_id % 2 AS half, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY ALL)
SELECT b.source, CASE WHEN a.n IS NULL THEN 'NEW' WHEN b.mean_chars < a.mean_chars * 0.95 THEN 'REGRESSED' WHEN b.mean_chars > a.mean_chars * 1.05 THEN 'IMPROVED' ELSE 'UNCHANGED' END AS status, b.mean_chars, a.mean_chars AS base_chars
FROM m b LEFT JOIN m a ON a.source = b.source AND a.half = 0 WHERE b.half = 1""")
def regression_status(spark, d):
    """One half of a source's documents against the other as its baseline, with a tolerance."""
    m = table(spark, d, "documents").groupBy("source", F.pmod("doc_id", F.lit(2)).alias("half")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    a, b = m.filter("half = 0").select("source", F.col("mean_chars").alias("base_chars")), m.filter("half = 1")
    status = F.when(F.col("base_chars").isNull(), "NEW").when(F.col("mean_chars") < F.col("base_chars") * 0.95, "REGRESSED").when(F.col("mean_chars") > F.col("base_chars") * 1.05, "IMPROVED").otherwise("UNCHANGED")
    return b.join(a, "source", "left").select("source", status.alias("status"), "mean_chars", "base_chars")


@query("""SELECT doc_id, round(greatest(0.0, least(1.0, 0.30 * quality + 0.10 * (1 - toxic) + 0.30 * least(1.0, n_chars / 5000.0) + 0.20 * (CASE WHEN lang = 'en' THEN 1 ELSE 0 END) + 0.10 * (CASE WHEN n_chars BETWEEN 100 AND 10000 THEN 1 ELSE 0 END))), 4) AS composite
FROM documents JOIN labels USING (doc_id)""")
def composite(spark, d):
    """Weighted measures clamped to 0..1; weights .30 .10 .30 .20 .10 are fixed values."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    s = 0.30 * F.col("quality") + 0.10 * (1 - F.col("toxic")) + 0.30 * F.least(F.lit(1.0), F.col("n_chars") / 5000.0) + 0.20 * F.when(F.col("lang") == "en", 1).otherwise(0) + 0.10 * F.when(F.col("n_chars").between(100, 10000), 1).otherwise(0)
    return x.select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 4).alias("composite"))


def _tag(name: str) -> str:
    return f"<{name}[ >]"


@query(" ".join(["SELECT page_id, n_p, n_a, n_li, CASE WHEN f = '' THEN 'ok' ELSE f END AS failures FROM (SELECT *, concat_ws(',', CASE WHEN n_p = 0 THEN 'no_paragraph' END, CASE WHEN n_a > 2 * n_p THEN 'link_heavy' END, CASE WHEN NOT closed THEN 'unclosed' END) AS f FROM (SELECT page_id,",
                 *(f"len(regexp_extract_all(html, '{_tag(t)}')) AS n_{t}," for t in ("p", "a", "li")), "contains(html, '</html>') AS closed FROM pages))"]))
def page_structure(spark, d):
    p = table(spark, d, "pages").select("page_id", *(F.regexp_count("html", F.lit(_tag(t))).cast("long").alias(f"n_{t}") for t in ("p", "a", "li")), F.contains("html", F.lit("</html>")).alias("closed"))
    f = F.concat_ws(",", F.when(F.col("n_p") == 0, "no_paragraph"), F.when(F.col("n_a") > 2 * F.col("n_p"), "link_heavy"), F.when(~F.col("closed"), "unclosed"))
    return p.select("page_id", "n_p", "n_a", "n_li", F.when(f == "", "ok").otherwise(f).alias("failures"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1) AS number, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""")
def url_parse(spark, d):
    x = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, d, "pages").select("page_id", F.lower(x("^([A-Za-z]+)://")).alias("scheme"), x("^[A-Za-z]+://([^/?#]+)").alias("host"), x("^[A-Za-z]+://[^/?#]+([^?#]*)").alias("path"), x("/([0-9]+)(?:[?#].*)?$").alias("number"), x(r"\?([^#]*)").alias("query"))


@query(rf"""WITH {LINES}, o AS (SELECT line, regexp_extract(line, '^\(?([0-9]{{1,3}})([.)、．])\)?[\x20\x09-\x0D]*', 0) AS o, regexp_extract(line, '^\(?([0-9]{{1,3}})([.)、．])\)?[\x20\x09-\x0D]*', 2) AS s FROM lines)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN line <> '' AND contains('{tx.BULLETS}', left(line, 1)) THEN 'bullet' WHEN o <> '' AND NOT (s IN ('.', '．') AND regexp_matches(substr(line, length(o) + 1, 1), '[0-9]')) THEN 'ordered' ELSE 'none' END AS kind FROM o) GROUP BY kind""")
def list_prefixes(spark, d):
    return lines(spark, d).groupBy(F.coalesce(tx.list_prefix(F.col("line"))["kind"], F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, left(text, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS preview, left(sha256(text), 16) AS cache_key, regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents""")
def cache_keys(spark, d):
    """Previews, content keys and slugs."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.left("text", F.lit(80)), F.when(F.length("text") > 80, "...").otherwise("")).alias("preview"), F.left(F.sha2("text", 256), F.lit(16)).alias("cache_key"), tx.slug(F.concat_ws(" ", "source", "lang")).alias("slug"))


@query("""SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_convs, sum(length(text))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rn FROM conversations) WHERE rn <= 3 GROUP BY role""")
def log_tail(spark, d):
    """The last three turns of each conversation, by role."""
    t = windows.last_n(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn"), "role", "text"], 3)
    return t.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"), F.sum(F.length("text")).alias("chars"))

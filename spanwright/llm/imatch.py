"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies within a band of the corpus: MIN_SHARE of the documents to
MAX_SHARE. As documents have a mean of d distinct terms, at most d / MIN_SHARE terms reach the band whatever the corpus
size; by a count, a lexicon of up to MAX_LISTED_TERMS goes along as a set of values, and a larger one is joined.
A document's distinct lexicon terms are sorted, and for each of TIERS * TRIALS random subsets of the lexicon those in the subset are
hashed in order. Trial i gives a term a hash; the subset of tier r holds terms whose hash ends in r zero bits, a
2 ** -r of the lexicon. So long and short documents both have tiers whose subsets hold about one of their
terms, and such subsets survive an edit most often.

A fingerprint is a field of 4 hexadecimal digits for each subset, by tier, or ---- for a subset with no term of the document, and
a last field: a hash of all lexicon terms, or of the whole text if it has none. The likeness of two equal
fingerprints is 1; otherwise it is the share of equal fields among those not empty in both, from the first tier on in which one of the
two has an empty field (fuller tiers only say that something differs); without such fields it is 1 or 0 as the last fields are equal or not.

Defined cases: a null text is an empty one; texts without a lexicon term are told apart by their whole text; equal texts have
equal fingerprints; rows with the same doc_id follow each other by text and are handled each; rows with a null doc_id come last
in the descending order; of one row alone the next document is itself; a very long text is read whole; an empty table gives an empty result.
Columns with other names are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash, table, text_of

MIN_SHARE, MAX_SHARE = 0.002, 0.2
MAX_LISTED_TERMS = 50_000
TIERS, TRIALS = 12, 6
EMPTY, DIGITS = "----", 4
#: Documents in a range of the order by doc_id, about.
RANGE_ROWS, MAX_RANGES = 2_000, 20_000


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes of lower-cased words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term) within the band; the counts cover all documents."""
    n = docs.count()
    df = docs.select(F.explode(term_hashes(text_of())).alias("term")).groupBy("term").count()
    return stash(df.filter(F.col("count").between(max(2.0, min_share * n), max_share * n)).select("term"), "lexicon")


def _field(x: Column) -> Column:
    return F.substring(F.lower(F.lpad(F.hex(x), 16, "0")), 1, DIGITS)


def fingerprint(d: DataFrame, terms: str, text_hash: str, new: str) -> DataFrame:
    """d with the fingerprint of the sorted distinct lexicon terms in column terms. A tier's subset lies in the tier's before it, so
    each is filtered from that one."""
    trials, t = [f"{terms}_{i}" for i in range(TRIALS)], F.col(terms)
    d = d.withColumns({f"{c}_0": F.transform(t, (lambda i: lambda x: F.xxhash64(x, F.lit(i)))(i)) for i, c in enumerate(trials)})
    for r in range(1, TIERS + 1):
        d = d.withColumns({f"{c}_{r}": F.filter(f"{c}_{r - 1}", (lambda bit: lambda g: g.bitwiseAND(F.lit(bit)) == 0)(1 << (r - 1))) for c in trials})
    fields = [F.when(F.size(f"{c}_{r}") == 0, EMPTY).otherwise(_field(F.xxhash64(f"{c}_{r}"))) for r in range(1, TIERS + 1) for c in trials]
    whole = F.when(F.size(t) == 0, _field(F.col(text_hash))).otherwise(_field(F.xxhash64(t)))
    return d.withColumn(new, F.concat(*fields, whole)).drop(*(f"{c}_{r}" for c in trials for r in range(TIERS + 1)))


def likeness(d: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """d with the likeness of two fingerprint columns for each new column of pairs. Each step is a column."""
    n = TIERS * TRIALS
    names = dict.fromkeys(x for pair in pairs.values() for x in pair)
    d = d.withColumns({f"__f_c_{x}": F.slice(F.regexp_extract_all(x, F.lit("." * DIGITS), F.lit(0)), F.lit(1), F.lit(n)) for x in names})
    first = lambda x: F.coalesce(F.nullif(F.array_position(f"__f_c_{x}", EMPTY), F.lit(0)), F.lit(n)).cast("int")
    start = lambda x, y: F.floor((F.least(first(x), first(y)) - 1) / TRIALS).cast("int") * TRIALS + 1
    # for each field that counts: true if equal
    same = lambda x, y: F.filter(F.zip_with(F.slice(f"__f_c_{x}", start(x, y), F.lit(n)), F.slice(f"__f_c_{y}", start(x, y), F.lit(n)), lambda p, q: F.when((p != EMPTY) | (q != EMPTY), p == q)), lambda e: e.isNotNull())
    d = d.withColumns({f"__f_e_{new}": same(x, y) for new, (x, y) in pairs.items()})
    def share(new: str, x: str, y: str) -> Column:
        e, last = F.col(f"__f_e_{new}"), F.when(F.right(x, F.lit(DIGITS)) == F.right(y, F.lit(DIGITS)), 1.0).otherwise(0.0)
        some = F.size(F.filter(e, lambda z: z)) / F.greatest(F.size(e), F.lit(1))
        return F.when(F.col(x).isNull() | F.col(y).isNull(), None).when(F.col(x) == F.col(y), 1.0).when(F.size(e) == 0, last).otherwise(some)
    d = d.withColumns({new: share(new, x, y) for new, (x, y) in pairs.items()})
    return d.drop(*(f"__f_c_{x}" for x in names), *(f"__f_e_{new}" for new in pairs))


def lexicon_terms(d: DataFrame, lex: DataFrame, columns: dict[str, str], key: list[str]) -> DataFrame:
    """d with the sorted distinct lexicon terms of each text column, under the new names. A lexicon of at most MAX_LISTED_TERMS goes along
    in the expression as a set; a larger one meets the terms by a join and the rows' key."""
    if lex.count() <= MAX_LISTED_TERMS:
        listed = ",".join(f"{r[0]}L" if r[0] > -(1 << 63) else f"{r[0] + 1}L - 1" for r in lex.collect())
        d = d.withColumns({new: term_hashes(F.col(c)) for c, new in columns.items()})
        return d.withColumns({new: F.expr(f"sort_array(filter({new}, t -> t IN ({listed})))" if listed else "cast(array() as array<bigint>)") for new in columns.values()})
    sides = F.array(*(F.struct(F.lit(k).alias("side"), term_hashes(F.col(c)).alias("terms")) for k, c in enumerate(columns)))
    each = d.select(*key, F.explode(sides).alias("x")).select(*key, "x.side", F.explode("x.terms").alias("term"))
    met = each.join(lex, "term").groupBy(*key).agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("term")))).alias(new) for k, new in enumerate(columns.values())))
    none = F.expr("cast(array() as array<bigint>)")
    return d.join(met, key, "left").withColumns({new: F.coalesce(new, none) for new in columns.values()})


def ranges(docs: DataFrame) -> Column:
    """A number for doc_id's range, from quantiles of all ids: ranges order the documents, rows of an id share one. -1 is for null ids; then
    0, which may be empty, and 1 and up, each of which holds the id it starts with. The bounds go along as two strings, MAX_RANGES numbers at most."""
    n = docs.count()
    parts = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    array = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")
    cuts = docs.agg(F.percentile_approx("doc_id", array([k / parts for k in range(1, parts)], "double"), 20 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    size = math.isqrt(len(cuts)) + 1  # two short searches and not one long one
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("doc_id")))
    b = below(array(cuts[::size], "bigint"))
    return F.when(F.col("doc_id").isNull(), -1).when(b == 0, 0).otherwise((b - 1) * size + below(F.slice(array(cuts, "bigint"), (b - 1) * size + 1, F.lit(size))))


def with_next(rows: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """rows with __f_at, their place in their range, and the value of the next row in descending order of __f_range and order, the first after the last.
    A range is one window; a copy of each range's first row stands at the end of the range before it."""
    r = F.col("__f_range").cast("int")
    known = rows.agg(F.min(r).alias("low"), F.max(r).alias("high"), F.count_if(r == 0).alias("zeros")).first()
    if known["high"] is None:
        return rows.withColumns({"__f_at": F.lit(0)} | {new: F.col(c) for c, new in values.items()})
    before = F.when(r == known["high"], known["low"]).when(r == -1, 0 if known["zeros"] else 1).otherwise(r + 1)
    first = rows.withColumn("__f_at", F.row_number().over(Window.partitionBy("__f_range").orderBy(*order))).filter("__f_at = 1").drop("__f_at")
    ghosts = first.withColumn("__f_range", before).withColumn("__f_ghost", F.lit(1))
    w = Window.partitionBy("__f_range").orderBy("__f_ghost", *order)
    both = rows.withColumn("__f_range", r).withColumn("__f_ghost", F.lit(0)).unionByName(ghosts)
    d = both.withColumns({new: F.lead(c).over(w) for c, new in values.items()} | {"__f_at": F.row_number().over(w)})
    return d.filter("__f_ghost = 0").drop("__f_ghost")


def op6_imatch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    lex = lexicon(docs)
    rows = docs.withColumn("__f_range", ranges(docs))
    n = F.length("text").cast("int")
    m = F.floor(n / 3).cast("int")
    d = with_next(rows, [F.col("doc_id").desc_nulls_last(), F.col("text").desc()], {"text": "next_text"})
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("next_text"), F.lit(1), m)))
    d = d.select("doc_id", "__f_range", "__f_at", "text", "edited", n.cast("long").alias("n_chars"))
    d = lexicon_terms(d, lex, {"text": "__f_t", "edited": "__f_e"}, ["__f_range", "__f_at"])
    d = d.select("doc_id", "__f_range", F.col("__f_at").alias("__f_place"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "__f_t", "__f_e", F.xxhash64("text").alias("__f_ht"), F.xxhash64("edited").alias("__f_he"))
    d = fingerprint(fingerprint(d, "__f_t", "__f_ht", "fingerprint"), "__f_e", "__f_he", "edited_fingerprint").drop("__f_t", "__f_e", "__f_ht", "__f_he")
    d = with_next(stash(d, "fingerprints"), [F.col("__f_place")], {"fingerprint": "next_fingerprint"})
    d = likeness(d, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

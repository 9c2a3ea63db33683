"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with share s of the output and n of the N documents has rate s * budget / n. Each document draws a Poisson
count by inverting the distribution at a uniform number from a hash of its id and a seed, so the draw is the same on
every run and machine. Documents are exploded by that count and shuffled globally by a hash of id and copy.

Defined cases: a null source is a source of its own; a null doc_id draws as the text 'null'; rows with the same id
draw the same count; a null, empty or very long text is a row like any other; a target for a source that has no rows does nothing, a source without a given
target gets none; an empty table gives an empty result. Columns with other names are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table

#: Without targets, a source's weight is its number of documents to this power.
TEMPERATURE, SEED = 0.7, 17
#: A table of rates up to this many sources is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000
P = "__m_"


def rates(docs: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """(source, rate, cdf): cdf[k] is the probability of at most k copies, to beyond the 52 bits of the draw."""
    n = docs.groupBy("source").count()
    if targets is None:
        weight = F.pow(F.col("count").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)), lambda k, _: k == F.col("source"))), F.lit(0)).cast("double"), F.lit(0.0))
    n = n.withColumn("weight", weight)
    total = n.agg(F.sum("count").alias("n"), F.sum("weight").alias("w")).first()
    size, whole = float(budget if budget is not None else total["n"] or 0), float(total["w"] or 1.0) or 1.0
    r = n.withColumn("rate", F.col("weight") / F.lit(whole) * F.lit(size) / F.col("count"))
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    # log of each probability from the one before it, so that large rates do not underflow
    step = lambda a, k: F.struct((a["log"] + F.log("rate") - F.log(k.cast("double"))).alias("log"), (F.get(a["cdf"], k - 1) + F.exp(a["log"] + F.log("rate") - F.log(k.cast("double")))).alias("last"), a["cdf"].alias("cdf"))
    first = F.struct((-F.col("rate")).alias("log"), F.exp(-F.col("rate")).alias("last"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    grown = F.aggregate(F.sequence(F.lit(1), top), first, lambda a, k: (lambda s: F.struct(s["log"].alias("log"), s["last"].alias("last"), F.concat(a["cdf"], F.array(s["last"])).alias("cdf")))(step(a, k)))
    return r.select("source", "count", "rate", F.when(F.col("rate") > 0, grown["cdf"]).otherwise(F.array(F.lit(1.0))).alias("cdf"))


def poisson_mix(docs: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """docs repeated by their draws, with __m_copies, __m_copy (from 1) and __m_key, dealt and sorted by key."""
    table_of = stash(rates(docs, targets, budget), "rates").select(F.col("source").alias(f"{P}source"), F.col("cdf").alias(f"{P}cdf"))
    if table_of.count() <= MAX_BROADCAST_SOURCES:
        table_of = F.broadcast(table_of)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    d = docs.join(table_of, docs["source"].eqNullSafe(F.col(f"{P}source")))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", own, F.lit(str(seed)))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    d = d.withColumn(f"{P}u", u).withColumn(f"{P}copies", F.size(F.filter(f"{P}cdf", lambda c: c <= F.col(f"{P}u"))).cast("long"))
    d = d.filter(F.col(f"{P}copies") > 0).withColumn(f"{P}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{P}copies"))))
    d = d.withColumn(f"{P}key", F.md5(F.concat_ws(":", own, F.col(f"{P}copy").cast("string"), F.lit(str(seed)))))
    return d.drop(f"{P}source", f"{P}cdf", f"{P}u").repartition(f"{P}key").sortWithinPartitions(f"{P}key")


def mixed(docs: DataFrame) -> DataFrame:
    return poisson_mix(docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))).select("row.*")


def op8_mixing(spark, sf_dir):
    """Whole documents, replicated and shuffled; of the text that arrives, its digest and length."""
    mix = poisson_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return mix.select("doc_id", "source", "lang", F.col(f"{P}copies").alias("copies"), F.col(f"{P}copy").alias("copy"), F.col(f"{P}key").alias("shuffle_key"), F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


ORACLE = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n::DOUBLE, {TEMPERATURE}) / (SELECT sum(pow(n::DOUBLE, {TEMPERATURE})) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
p AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS pmf FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 21)::BIGINT)) AS k FROM r)),
c AS (SELECT source, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT doc_id, source, lang, text, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 13))::BIGINT / 4503599627370496.0 AS u, row_number() OVER () AS pos FROM documents),
e AS (SELECT d.pos, d.doc_id, d.source, d.lang, d.text, count(*) FILTER (WHERE cdf <= u) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, lang, copies, copy, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || copy || ':{SEED}') AS shuffle_key, md5(text) AS text_md5, length(text) AS text_chars
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM e)
"""

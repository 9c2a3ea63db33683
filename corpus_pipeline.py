"""The corpus pipeline: documents through five stages to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Each result is written as Parquet to the shared folder and read again as the next stage's docs, so a lost executor costs a stage's
tasks at most.

Defined cases, for every stage: a null or empty text has no words, so the first stage drops it, and later ones take it as it is; rows with a null doc_id are
judged, neither lose lines nor name a group, are mixed and packed; repeated rows are judged alike, lose the same lines, count as one group of
copies (the least row stays), and draw the same count; a very long text is read whole; ties go to the smallest doc_id; an empty table gives an empty result; further
columns are kept up to the last stage, whatever their names. No SQL oracle: words, digests and tokens are not SQL; tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm import line_dedup, mixing, near_copies, packing, quality, simhash
from spanwright.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, near_copies.near_groups)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs

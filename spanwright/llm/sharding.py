"""Sharding by Karmarkar-Karp differencing: groups of equal texts, which no shard may split, in byte balance.

Groups are summed before anything else, so a group of a third of all rows is one row. Groups of more than a LARGE-th of all bytes,
fewer than LARGE by that rule, are items of their own; the others are bundled by hash into BUNDLES items. So the
differencing has a bounded number of items at any corpus size, and still sees each group that could unbalance a shard.
It keeps a heap of partial partitions by their spread and combines the two largest, oppositely ordered, until one is left.

Rows find their item by a broadcast of those bounded tables. Slots are numbered in ranges of a shard, a window each, from
counts of the ranges before.

Defined cases: a null text is an empty one (size 16, crc 0); repeated rows are in one group and have a slot each; a null doc_id
is dealt like others; ties are broken by item and by doc_id; fewer groups than shards leave shards empty; an empty table
gives an empty result; a very long text is one row of its size. Columns with other names are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table, text_of

SHARDS, OVERHEAD = 40, 16
LARGE, BUNDLES = 40_000, 8_000
#: Rows in a range of a shard, about.
RANGE_ROWS = 5_000


def differencing(sizes: list[int], k: int = SHARDS) -> list[int]:
    """A part, 0 to k - 1, for each size."""
    if not sizes:
        return []
    # a node: sums in descending order; leaves have their size first
    sums: list[np.ndarray] = []
    made: list[tuple[int, int, np.ndarray] | None] = []
    heap = []
    for i, n in enumerate(sizes):
        s = np.zeros(k, dtype=np.int64)
        s[0] = n
        sums.append(s)
        made.append(None)
        heap.append((-n, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        s = sums[a] + sums[b][::-1]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        sums.append(s - s[-1])
        made.append((a, b, order))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(s[0] - s[-1]), len(sums) - 1))
    # from the whole back to the leaves: where each place of a node ended
    part, todo = [0] * len(sizes), [(len(sums) - 1, np.arange(k))]
    while todo:
        n, at = todo.pop()
        if made[n] is None:
            part[n] = int(at[0])
            continue
        a, b, order = made[n]
        before = np.empty(k, dtype=np.int64)
        before[order] = at
        todo += [(a, before), (b, before[::-1])]
    return part


def _bundle(group: Column) -> Column:
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(group), F.lit(BUNDLES)).cast("string"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    t = text_of().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("g"))
    rows = stash(rows, "shard-rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    is_large = F.col("bytes") * LARGE > total["bytes"]
    items = groups.withColumn("item", F.when(is_large, F.col("g")).otherwise(_bundle(F.col("g")))).groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()
    items.sort(key=lambda r: (-r["bytes"], r["item"]))  # LARGE + BUNDLES at most
    spark = docs.sparkSession
    placed = spark.createDataFrame(list(zip((r["item"] for r in items), differencing([r["bytes"] for r in items], shards))), "item string, shard int")
    large = F.broadcast(placed.filter(F.length("item") == 32).select(F.col("item").alias("g"), F.col("shard").alias("own")))
    small = F.broadcast(placed.filter(F.length("item") < 32).select(F.col("item").alias("b"), F.col("shard").alias("common")))
    ranges = max(1, total["n"] // (shards * RANGE_ROWS))
    d = rows.join(large, "g", "left").withColumn("b", _bundle(F.col("g"))).join(small, "b", "left").withColumn("shard", F.coalesce("own", "common"))
    d = d.withColumn("range", F.pmod(F.xxhash64("doc_id", "g"), F.lit(ranges)))
    counts = d.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).drop("n")
    d = d.withColumn("at", F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "g")) - 1)
    return d.join(before, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).alias("slot"))


def op10_sharding(spark, sf_dir):
    d = shard(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

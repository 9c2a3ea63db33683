"""SimHash near-dedup: fingerprints, a binary trie self-join for close pairs, and connected components.

Two fingerprints within BUDGET = 2 bits agree on at least one of three blocks of their bits, so each
distinct fingerprint is dealt out three times, by block. A partition sorts what it got: its rows are then the
leaves of binary tries, one below each block value, and a node is a range of the sorted array. Pairs of nodes
are walked down together, one bit a level for all tries at once; a pair is pruned when the bits that differ so far exceed
the budget. What a walk finds is reduced to a spanning forest of the partition's links before it leaves, so a large
group of near copies yields one link a member, not all pairs. Components come from alternating
large-star and small-star steps, each written to the shared folder.

Defined cases: a text without words (or null, or empty) has fingerprint zero and is linked like any other; fewer than three words are one shingle;
repeated rows have one fingerprint; rows with a null doc_id link like others but never name a component (null if no
row of it has an id); ties of a bit, set in just half the shingles, give 0; a very long text is read whole; an empty table gives an
empty result. Columns with other names are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import stash, table

SHINGLE, BUDGET, SEED = 3, 2, 42
#: (lowest bit, width) of the blocks that two close fingerprints share one of at least.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Pairs of nodes walked down at once; more wait on a stack. Dealt fingerprints in a partition, about.
FRONT, DEALT = 1 << 20, 1 << 20
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(text: str | None, words_each: int) -> np.ndarray:
    """Hashes of the runs of so many lower-cased words, in order; a shorter text is one run, one without words none."""
    words = (text or "").encode().lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(joined, SEED)] if words else [], dtype=np.uint64)
    at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = [0, *at[:-words_each].tolist()], (at[words_each - 1:] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    h = shingles(text, SHINGLE)
    if not len(h):
        return 0
    planes = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    set_in = np.concatenate([np.bincount(planes[:, i], minlength=256) @ BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * set_in > len(h)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(fingerprint(t)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def walk(groups: np.ndarray, rest: np.ndarray, bits: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between rows of one group whose rest differs in budget bits at most. Rows are sorted by (group, rest)."""
    n = len(rest)
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[edge, n])
    lo, hi = edge[size > 1], (edge + size)[size > 1]
    ones = np.empty((bits, n + 1), np.int32)  # of each level: rows with a one before this place
    for level in range(bits):
        ones[level, 0] = 0
        np.cumsum((rest >> np.uint64(bits - 1 - level)) & np.uint64(1), out=ones[level, 1:])
    stack = [(0, lo[i:i + FRONT], hi[i:i + FRONT], lo[i:i + FRONT], hi[i:i + FRONT], np.zeros(len(lo[i:i + FRONT]), np.int8)) for i in range(0, len(lo), FRONT)]
    left, right = [], []
    while stack:
        level, al, ah, bl, bh, d = stack.pop()
        while level < bits and len(al):
            c = ones[level]
            am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
            same = al == bl
            parts = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1), (am[~same], ah[~same], bl[~same], bm[~same], d[~same] + 1)]
            al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*parts))
            alive = (ah > al) & (bh > bl) & (d <= budget) & ~((al == bl) & (ah - al == 1))
            al, ah, bl, bh, d = al[alive], ah[alive], bl[alive], bh[alive], d[alive].astype(np.int8)
            level += 1
            alone = (ah - al == 1) & (bh - bl == 1)  # two leaves: count the differing bits that remain
            if alone.any():
                i, j = al[alone], bl[alone]
                ok = np.bitwise_count(rest[i] ^ rest[j]) <= budget
                left.append(i[ok])
                right.append(j[ok])
                al, ah, bl, bh, d = (x[~alone] for x in (al, ah, bl, bh, d))
            if len(al) > FRONT:
                stack.extend((level, *(x[i:i + FRONT] for x in (al, ah, bl, bh, d))) for i in range(FRONT, len(al), FRONT))
                al, ah, bl, bh, d = (x[:FRONT] for x in (al, ah, bl, bh, d))
        # at the last level a node is one fingerprint: rows are distinct, so nothing remains here
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) for each non-root member of the components of these links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    block, fp = np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]).view(np.uint64)
    del got
    for k, (low, width) in enumerate(BLOCKS):
        f = fp[block == k]
        mask = np.uint64(((1 << width) - 1) << low)
        above = np.uint64(low + width)
        rest = (f & np.uint64((1 << low) - 1)) | ((f >> above) << np.uint64(low) if low + width < 64 else np.uint64(0))
        group = (f & mask) >> np.uint64(low)
        order = np.lexsort((rest, group))
        f, group, rest = f[order], group[order], rest[order]
        pairs = forest(*walk(group, rest, 64 - width))
        if pairs:
            i, j = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(f[i].view(np.int64)), pa.array(f[j].view(np.int64))], ["a", "b"])


def _block(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever fingerprints are within the budget."""
    keyed = distinct.select("fp", F.posexplode(F.array(*(_block(F.col("fp"), *x) for x in BLOCKS))).alias("block", "at"))
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(BLOCKS) * distinct.count() // DEALT)
    return keyed.repartition(parts, "block", "at").select("block", "fp").mapInArrow(_links, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    fps = stash(fingerprints(docs), "simhash")
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(distinct.select("fp")), "a", "b").toDF("node", "root")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(ids, "root").select("fp", "component_id"), "fp")


def one_of_each(docs: DataFrame, groups_of: Callable[[DataFrame], DataFrame] = near_groups) -> DataFrame:
    """The documents that name their group of near copies (the smallest doc_id), each once: of rows that share an id the least,
    column by column. Rows without an id stay. groups_of: gives doc_id and component_id of each row."""
    groups = groups_of(docs.filter("doc_id is not null"))
    keep = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"))
    orderable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    kept = kept.groupBy("doc_id").agg(F.min_by("row", F.struct(*(F.col("row").getField(c) for c in orderable))).alias("row"))
    return kept.select("row.*").unionByName(docs.filter("doc_id is null"))


def op4_simhash(spark, sf_dir):
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

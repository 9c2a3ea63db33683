"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what links join.

The method is SimHash with binary tries. A text's fingerprint has BITS bits, each set in over half of the set's hashes; two sets of similarity 0.8
differ in about 0.15 of them, in 0.165 at most but for sets of 4 and 5 shingles (0.1875). A budget on all bits at once would have a trie walk visit nearly
all pairs, so the trie self-join runs over many tables: each takes some bits of the fingerprint, a trie of them is walked down for pairs within BUDGET bits, and pairs
that it finds are held against all bits. The number of tables follows from the number of fingerprints, so that a pair of similarity 0.8 is in
no table with a probability of MISS. Sketches then drop pairs that only share passages: a sketch holds, for each of M buckets of shingles,
whether their number is odd, so two sketches differ in about as many bits as the sets in shingles; sets of over M shingles are sampled by hash, by half for
each doubling. The bound is what sets of similarity 0.8 differ in, and FAR standard deviations more (a pair in 300,000 lies beyond). Each link
that remains is confirmed on the whole sets. Equal sets are one node.

Tables are dealt in slots, a slot's tables to one task. Where there are more than DEALT fingerprints a slot is dealt by some more bits, that its pairs agree on.
A slot first emits a spanning forest of the pairs that it finds, so that a large group of near copies costs one link a member; a text that is near to any is in it.
Those texts alone are walked again with their sketches, for a forest of the pairs that confirmed links leave apart, and then for all of these.

Defined cases: a text of less than six words is one shingle; texts without words (or null, or empty) are one node; rows with a null
doc_id never name a component; repeated rows are one node; a very long text is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import stash
from .simhash import SEED, shingles, walk

#: Bits of a fingerprint, of the trie's budget in a table, and of what may differ in all (0.1875, the most at a similarity of 0.8, and 4.5 standard deviations).
SHINGLE, BITS, BUDGET, SPAN = 5, 512, 1, 136
#: The share of bits that tables are counted for, and the share of pairs that may be in none; slots at least; fingerprints in a slot's part, about.
DIFFER, MISS, SLOTS, DEALT = 0.165, 1e-6, 12, 1 << 19
#: Bits of a sketch, and the standard deviations that the bound on differing bits allows.
M, FAR = 1024, 4.5
_RANDOM = np.random.default_rng(SEED)
ODD = _RANDOM.integers(0, 1 << 63, BITS // 64 + 2, np.uint64) * np.uint64(2) + np.uint64(1)
#: Longs of a sketch; pairs held against each other at once.
LONGS, CHUNK = M // 64, 1 << 18


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingles(text, SHINGLE))


def node_of(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED))))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The longs of a SimHash fingerprint: each hash of the set is widened to BITS bits; a bit is 1 if set in over half of them."""
    set_in = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 255):
        h = found[i:i + 255, None] * ODD[:BITS // 64]
        h = (h ^ (h >> np.uint64(29))) * ODD[BITS // 64]
        set_in += np.unpackbits((h ^ (h >> np.uint64(32))).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_in > len(found), bitorder="little").view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Level, size, and the odd buckets of a 2 ** -level of the shingles and of half as many."""
    level = max(0, (len(found) - 1).bit_length() - (M.bit_length() - 1))
    g = (found ^ (found >> np.uint64(31))) * ODD[BITS // 64 + 1]
    parts = []
    for k in (level, level + 1):
        some = g[((g >> np.uint64(8)) & np.uint64((1 << k) - 1)) == 0]
        odd = np.bincount((some >> np.uint64(65 - M.bit_length())).astype(np.int64), minlength=M) & 1
        parts.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return np.concatenate([np.array([level, len(found)], np.int64), *parts])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text without shingles has no fingerprint: nothing is near to it but its like."""
    for b in batches:
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        longs = pa.list_(pa.int64())
        fps, sketches = ([f(x) if len(x) else [] for x in sets] for f in (fingerprint, sketch))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([node_of(x) for x in sets], pa.int64()), pa.array(fps, longs), pa.array(sketches, longs)], ["doc_id", "node", "fp", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "found"])


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those pairs that are similar enough, exactly."""
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("of_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("found").alias("of_a")), "a")
    x = x.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return x.filter(9 * F.col("both") >= 4 * F.col("sizes")).select("a", "b")


def missed(slots: int, shared: int, tables: float, width: int) -> float:
    """The share of pairs, each bit of which differs with probability DIFFER, that no table finds."""
    total = 0.0
    for d in range(BITS // 2):
        log = math.lgamma(BITS + 1) - math.lgamma(d + 1) - math.lgamma(BITS - d + 1) + d * math.log(DIFFER) + (BITS - d) * math.log(1 - DIFFER)
        f, bits = d / BITS, width - shared
        found = sum(math.comb(bits, k) * f ** k * (1 - f) ** (bits - k) for k in range(BUDGET + 1))
        agree = (1 - f) ** shared
        total += math.exp(log) * (1 - agree * (1 - (1 - found) ** tables)) ** slots
    return total


def plan(n: int) -> tuple[int, int, int, int]:
    """For so many fingerprints: slots, bits that a slot is dealt by, tables of a slot, and bits of a table with those."""
    shared = max(0, math.ceil(math.log2(max(n, 1) / DEALT)))
    width = max(12, math.ceil(math.log2(max(n, 2))) + 2)
    slots = next(s for s in range(SLOTS, 10_000) if missed(s, shared, math.inf, width) <= MISS / 2)
    return slots, shared, next(t for t in range(1, 10_000) if missed(slots, shared, t, width) <= MISS), width


def _order(slot: int, *more: int) -> np.ndarray:
    return np.random.default_rng([SEED, slot, *more]).permutation(BITS)


def dealt(nodes: DataFrame, slots: int, shared: int) -> DataFrame:
    """Nodes with a fingerprint, once for each slot, each slot's part in a partition of its own."""
    bit = lambda p: F.shiftright(F.get("fp", F.lit(int(p) // 64)), int(p) % 64).bitwiseAND(F.lit(1))
    part = lambda s: sum((F.shiftleft(bit(p), i) for i, p in enumerate(_order(s)[:shared])), F.lit(s << shared).cast("long")).cast("int")
    out = nodes.filter(F.size("fp") > 0).withColumn("part", F.explode(F.array(*(part(s) for s in range(slots)))))
    return out.repartitionById(slots << shared, "part")


def products(at_a: np.ndarray, n_a: np.ndarray, at_b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of each pair of ranges, some at a time."""
    ends = np.cumsum(n_a * n_b)
    for s in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        flat = np.arange(s, min(s + CHUNK, int(ends[-1])))
        k = np.searchsorted(ends, flat, side="right")
        in_k = flat - (ends[k] - n_a[k] * n_b[k])
        yield at_a[k] + in_k // n_b[k], at_b[k] + in_k % n_b[k]


def _starts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(new)
    return at, np.diff(np.r_[at, len(new)])


def near_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of sketches: the smaller size is 0.8 of the larger, and at the higher of both levels the bits that differ are within the bound."""
    at = np.maximum(a[:, 0], b[:, 0])
    sizes = a[:, 1] + b[:, 1]
    ok = (5 * np.minimum(a[:, 1], b[:, 1]) >= 4 * np.maximum(a[:, 1], b[:, 1])) & (at - a[:, 0] <= 1) & (at - b[:, 0] <= 1)
    parts = [np.where((at > x[:, 0])[:, None], x[:, 2 + LONGS:], x[:, 2:2 + LONGS]) for x in (a, b)]
    bits = np.bitwise_count((parts[0] ^ parts[1]).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed longs it counts the absolute value's bits
    share = 2.0 ** -at
    d = sizes / 9.0 * share  # sampled shingles that sets of similarity 0.8 differ in
    left = np.exp(-4.0 * d / M)
    spread = np.maximum(0.0, M / 4.0 * (1 - left) - d * left) + left * d * (1 - share)
    return ok & (bits <= M / 2.0 * (1 - np.exp(-2.0 * d / M)) + FAR * np.sqrt(spread) + 1)


class _Slot:
    """The rows of one part of a slot: fingerprints, sizes, labels (those of one label need no link), and sketches if any."""

    def __init__(self, fp: np.ndarray, size: np.ndarray, label: np.ndarray, sketches: np.ndarray | None):
        self.fp, self.size, self.label, self.sketches = fp, size, label, sketches

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = 5 * np.minimum(self.size[i], self.size[j]) >= 4 * np.maximum(self.size[i], self.size[j])
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(axis=1, dtype=np.int64) <= SPAN
        i, j = i[ok], j[ok]
        if self.sketches is not None:
            ok = near_sketches(self.sketches[i], self.sketches[j])
            i, j = i[ok], j[ok]
        return i, j

    def joined(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gives what these pairs join one label, and returns the pairs of a spanning forest."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        keep = []
        for k, (a, b) in enumerate(zip(self.label[i].tolist(), self.label[j].tolist())):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                keep.append(k)
        if keep:
            to = np.arange(len(self.label))
            to[list(parent)] = [root(x) for x in list(parent)]
            self.label = to[self.label]
        return i[keep], j[keep]

    def table(self, positions: np.ndarray, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of two labels that are within the budget in these bits, and near; forest: of those only what joins labels."""
        value = np.zeros(len(self.fp), np.uint64)
        for p in positions.tolist():
            value = value << np.uint64(1) | (self.fp[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
        order = np.argsort(value, kind="stable")
        at, many = _starts(np.r_[True, np.diff(value[order]) != 0])
        left, right = walk(np.zeros(len(at), np.int64), value[order[at]], len(positions), BUDGET)
        if forest:  # the least row of each value first: what is linked to it needs no further pairs
            i, j = np.repeat(order[at], many), order
            i, j = np.r_[i, order[at[left]]], np.r_[j, order[at[right]]]
            apart = self.label[i] != self.label[j]
            yield self.joined(*self.near(i[apart], j[apart]))
        order = np.lexsort((self.label, value))
        label, value = self.label[order], value[order]
        new = np.r_[True, np.diff(value) != 0]
        run, rows = _starts(new | np.r_[True, np.diff(label) != 0])
        first, runs = _starts(new[run])
        several = np.flatnonzero(runs > 1)
        left, right = np.r_[left, several], np.r_[right, several]
        for a, b in products(first[left], runs[left], first[right], runs[right]):
            apart = (label[run[a]] != label[run[b]]) & ((value[run[a]] != value[run[b]]) | (a < b))
            a, b = a[apart], b[apart]
            for i, j in products(run[a], rows[a], run[b], rows[b]):
                i, j = self.near(order[i], order[j])
                yield self.joined(i, j) if forest else (i, j)


def _matrix(column: list[pa.Array], longs: int) -> np.ndarray:
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False).reshape(-1, longs) for x in column])


def _positions(slot: int, table: int, shared: int, width: int) -> np.ndarray:
    bits = _order(slot, table)
    return bits[~np.isin(bits, _order(slot)[:shared])][:width - shared]


def _differing(fp: np.ndarray, positions: np.ndarray) -> np.ndarray:
    mask = np.packbits(np.bincount(positions, minlength=BITS).astype(np.uint8), bitorder="little").view(np.uint64)
    return np.bitwise_count(fp & mask).sum(axis=1, dtype=np.int64)


def _first_found(differ: np.ndarray, slot: int, shared: int, tables: int, width: int) -> np.ndarray:
    """Which pairs, given as the bits that differ, no table of a slot before this one finds."""
    left = np.arange(len(differ))
    for s in range(slot):
        agree = _differing(differ[left], _order(s)[:shared]) == 0
        for t in range(tables):
            found = agree & (_differing(differ[left], _positions(s, t, shared, width)) <= BUDGET)
            left, agree = left[~found], agree[~found]
    return left


def _pairs(batches: Iterator[pa.RecordBatch], shared: int, tables: int, width: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b) of the near pairs of each part that roots, if given, leave apart: a spanning forest of them, or all, each in the first slot that finds it."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    column = lambda c: [b.column(c) for b in got]
    part, node, size = (np.concatenate([x.to_numpy() for x in column(c)]) for c in ("part", "node", "size"))
    fp, again = _matrix(column("fp"), BITS // 64).view(np.uint64), "root" in got[0].schema.names
    roots = np.unique(np.concatenate([x.to_numpy() for x in column("root")]), return_inverse=True)[1] if again else None
    sketches = _matrix(column("sketch"), 2 + 2 * LONGS) if again else None
    del got
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        rows = rows[np.argsort(node[rows])]
        slot = int(p) >> shared
        here = _Slot(fp[rows], size[rows], roots[rows] if again else np.arange(len(rows)), sketches[rows] if again else None)
        found = [(np.zeros(0, np.int64),) * 2]
        for t in range(tables):
            found += here.table(_positions(slot, t, shared, width), forest)
        i, j = (rows[np.concatenate(x)] for x in zip(*found))
        i, j = np.divmod(np.unique(np.minimum(i, j) * len(node) + np.maximum(i, j)), len(node))
        if not forest:
            first = _first_found(fp[i] ^ fp[j], slot, shared, tables, width)
            i, j = i[first], j[first]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j]), pa.int64()), pa.array(np.maximum(node[i], node[j]), pa.int64())], ["a", "b"])


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            ok = near_sketches(*(_matrix([b.column(c)], 2 + 2 * LONGS) for c in ("of_a", "of_b")))
            yield b.select(["a", "b"]).filter(pa.array(ok))


def candidates(nodes: DataFrame, forest: bool) -> DataFrame:
    """(a, b) of nodes with fp and sketch, and root if some are linked: a spanning forest of each slot's pairs between roots, or all of them."""
    slots, shared, tables, width = plan(nodes.count())
    given = dealt(nodes.withColumn("size", F.get("sketch", F.lit(1))).select("node", "fp", "size", *(["root", "sketch"] if "root" in nodes.columns else [])), slots, shared)
    return given.mapInArrow(partial(_pairs, shared=shared, tables=tables, width=width, forest=forest), "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, node, component_id) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = stash(docs.mapInArrow(_signatures, "doc_id long, node long, fp array<long>, sketch array<long>"), "signatures")
    nodes = stash(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "nodes")  # equal nodes have equal fingerprints
    forest = stash(candidates(nodes, True), "forest")
    with_sketch = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"of_{c}"))
    near = forest.join(with_sketch("a"), "a").join(with_sketch("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(_near_rows, "a long, b long")
    links = stash(_confirmed(stash(near, "near"), docs, rows), "links")

    linked = forest.select(F.col("a").alias("node")).union(forest.select("b")).distinct()  # who is near to any is in the forest
    again = stash(nodes.join(linked, "node", "left_semi"), "again")
    for whole in (False, True):
        roots = connected_components(links, "a", "b").toDF("node", "root")
        placed = stash(again.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        more = _confirmed(stash(candidates(placed, not whole), "open" if whole else "trees"), docs, rows)
        links = stash(placed.select(F.col("root").alias("a"), F.col("node").alias("b")).filter("a <> b").union(more), "links")
    final = connected_components(links, "a", "b").toDF("node", "root")
    named = nodes.select("node", "first").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(ids, "root").select("node", "component_id"), "node")


def _confirmed(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that are near, from the sets of one document of each node in them."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = rows.join(named, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    found = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(_sets, "node long, found array<long>")
    sets = stash(found.dropDuplicates(["node"]), "sets")
    return measured(pairs, sets)

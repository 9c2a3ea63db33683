"""Line dedup with two Bloom filters.

Each document's distinct line keys become pairs (doc_id, 128-bit digest in two halves), written once. Each task that reads them fills
two filters of its own, of hashes seen once and of hashes seen twice, in which a hash sets two bits, and hands both on in SEGMENTS
compressed parts. Parts are merged in a tree, by segment and salt and then, if there are salts, by segment: a bit is in the merged filter of twice-seen hashes if it
is in one of those, or in the filters of once-seen hashes of two. That filter goes to all tasks, which read the pairs
again and let only its hits, the suspected repeats, shuffle. They are confirmed on the full digest (at 10^12 different
lines the chance of one false match is about 1e-15), which also finds the first document. A false positive costs a row in that
shuffle and nothing else.

The filter has 8 to 16 bits for each pair, a number that is counted first, which leaves 1 to 5 % of unrepeated lines as
suspects, and 2 ** MOST_BITS at most (128 MB, the bound of what is broadcast), enough for 130 million pairs. Beyond that it fills up: of half a billion 40 % are
suspects, and with very many all shuffle (24 bytes a line), so the work stays in proportion to the corpus.

A worker holds what Arrow hands it (64 MB of a table by default) and, of its own, one document with its lines and digests, HELD pairs or HELD_BYTES of
texts to hand on, two filters or one. Filters are handed on segment by segment.

A line in a third of all documents sets the same bits again and again, and its suspects are combined before they shuffle; the join that tells its
documents is on a written table, so that it may be split.

Defined cases: null and empty texts are one empty line; keys under 10 code points stay; rows with the
same doc_id are one document for counting, each row losing the same lines; a null doc_id neither causes nor
suffers a drop; a very long text is read whole; an empty table gives an empty result. Other columns are kept; names that start with __l_ are
taken by this operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table

MIN_KEY, SPACE = 10, b" \t\n\x0b\x0c\r"
#: Bits of a filter as powers of two, at least and at most; parts that a filter is handed on in.
LEAST_BITS, MOST_BITS, SEGMENTS = 14, 30, 64
#: Pairs whose bits a task of the first step of a merge takes, about; salts of a segment at most.
MERGED, MOST_SALTS = 1 << 22, 64
#: Rows of a batch whose bits are set at once.
ROWS = 1 << 20
#: Pairs and bytes of kept texts that a worker gathers before it hands them on, besides the last document's.
HELD, HELD_BYTES = 1 << 15, 1 << 22


def key_of(line: bytes) -> bytes | None:
    """The key of a line if it is long enough; bytes.lower() changes A-Z only."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_KEY or (len(key) < 4 * MIN_KEY and len(key.decode()) < MIN_KEY):
        return None
    return key


#: A key's digest, 16 bytes; its halves as the tables hold them are signed, and 2 ** 63 less.
_digest = xxhash.xxh3_128_digest


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The high and the low halves of digests that stand one behind the other."""
    u = np.frombuffer(digests, ">u8").astype(np.uint64) ^ np.uint64(1 << 63)
    return u[::2].view(np.int64), u[1::2].view(np.int64)


def _digests(hi: np.ndarray, lo: np.ndarray) -> set[bytes]:
    """The digests of such halves."""
    raw = (np.stack([hi, lo], 1).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes()
    return {raw[i:i + 16] for i in range(0, len(raw), 16)}


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    """Texts as UTF-8, one at a time; null is empty."""
    for t in texts:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        columns = np.repeat(np.array(ids, np.int64), np.array(counts, np.int64)), *_halves(bytes(digests))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "hi", "lo"])

    for b in batches:
        ids, counts, digests = [], [], bytearray()
        for i, t in zip(b.column(0), _bytes(b.column(1))):
            if not i.is_valid or not t:
                continue
            found = {_digest(k) for line in t.split(b"\n") if (k := key_of(line)) is not None}
            ids.append(i.as_py())
            counts.append(len(found))
            digests += b"".join(found)
            if len(digests) >= 16 * HELD:
                yield batch()
                ids, counts, digests = [], [], bytearray()
        yield batch()


def filter_bits(pairs: int) -> int:
    """The power of two of a filter's bits: 8 to 16 for each pair."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * pairs).bit_length()))


def _places(hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash, from different parts of it."""
    u = hi.view(np.uint64)
    return (u >> np.uint64(64 - bits)).astype(np.int64), (u & np.uint64((1 << bits) - 1)).astype(np.int64)


class Filters:
    """Bits of hashes seen once at least and twice at least. Bits are held by segment, each made when a hash first falls into it."""

    def __init__(self, bits: int):
        self.bits, self.width = bits, bits - SEGMENTS.bit_length() + 1
        self.once: dict[int, np.ndarray] = {}
        self.twice: dict[int, np.ndarray] = {}

    def _or(self, where: dict[int, np.ndarray], at: np.ndarray) -> None:
        segment = at >> self.width
        cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(at) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            if (part := where.get(k := int(segment[a]))) is None:
                part = where[k] = np.zeros(1 << (self.width - 3), np.uint8)
            x = at[a:b] & ((1 << self.width) - 1)
            byte, first = np.unique(x >> 3, return_index=True)
            part[byte] |= np.bitwise_or.reduceat(np.uint8(1) << (x & 7).astype(np.uint8), first)

    def _has(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), bool)
        segment = at >> self.width
        cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(at) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            if (part := self.once.get(int(segment[a]))) is not None:
                x = at[a:b] & ((1 << self.width) - 1)
                out[a:b] = part[x >> 3] >> (x & 7).astype(np.uint8) & 1
        return out

    def add(self, ids: np.ndarray, hi: np.ndarray) -> None:
        """Hashes of pairs: twice seen if this filter has the bit from before, or two documents of these hold the hash."""
        order = np.lexsort((ids, hi))
        ids, hi = ids[order], hi[order]
        first = np.flatnonzero(np.r_[True, hi[1:] != hi[:-1]])
        last = np.r_[first[1:], len(hi)] - 1
        many, hi = ids[first] != ids[last], hi[first]
        for at in _places(hi, self.bits):
            order = np.argsort(at, kind="stable")
            at, again = at[order], many[order]
            again = again | self._has(at) | np.r_[False, at[1:] == at[:-1]]
            self._or(self.once, at)
            self._or(self.twice, at[again])

    def merge(self, segment: int, once: bytes | None, twice: bytes | None) -> None:
        size = 1 << (self.width - 3)
        read = lambda x: np.frombuffer(zstandard.decompress(x), np.uint8) if x else np.zeros(size, np.uint8)
        o, t = read(once), read(twice)
        if segment not in self.once:
            self.once[segment], self.twice[segment] = o.copy(), t.copy()
            return
        self.twice[segment] |= t | (self.once[segment] & o)
        self.once[segment] |= o

    def parts(self) -> Iterator[pa.RecordBatch]:
        """One segment at a time; this filter forgets what it has handed on."""
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in sorted(self.once):
            once, twice = self.once.pop(k), self.twice.pop(k, None)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(once.tobytes())], pa.binary()),
                                              pa.array([pack(twice.tobytes()) if twice is not None else None], pa.binary())], ["segment", "once", "twice"])


PARTS = "segment int, once binary, twice binary"


def twice_filter(pairs: DataFrame, n: int, bits: int) -> list[bytes | None]:
    """By segment, the bits of hashes seen twice at least. A task holds two filters and hands on their parts."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(bits)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                f.add(b.column(0)[lo:lo + ROWS].to_numpy(), b.column(1)[lo:lo + ROWS].to_numpy())
        yield from f.parts()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(bits)
        for b in batches:
            for segment, once, twice in zip(*(c.to_pylist() for c in (b.column("segment"), b.column("once"), b.column("twice")))):
                f.merge(segment, once, twice)
        yield from f.parts()

    tasks = -(-n // MERGED)
    salts = min(MOST_SALTS, -(-tasks // SEGMENTS))
    parts = pairs.select("id", "hi").mapInArrow(fill, PARTS).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    some = parts.repartition(max(8, min(tasks, SEGMENTS * salts)), "segment", "salt").select("segment", "once", "twice").mapInArrow(merge, PARTS)
    whole = (some.repartition(SEGMENTS // 4, "segment").mapInArrow(merge, PARTS) if salts > 1 else some).select("segment", "twice")
    out: list[bytes | None] = [None] * SEGMENTS
    for r in whole.collect():  # SEGMENTS rows, 2 ** MOST_BITS bits at most in all
        out[r["segment"]] = bytes(r["twice"]) if r["twice"] is not None else None
    return out


def suspects(pairs: DataFrame) -> DataFrame:
    """The pairs whose hash the filter of those seen twice holds."""
    n = pairs.count()
    bits = filter_bits(n)
    shared = pairs.sparkSession.sparkContext.broadcast(twice_filter(pairs, n, bits))
    width = bits - SEGMENTS.bit_length() + 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (width - 3)
        bitmap = np.zeros(SEGMENTS * size, np.uint8)
        for k, x in enumerate(shared.value):
            if x:
                bitmap[k * size:(k + 1) * size] = np.frombuffer(zstandard.decompress(x), np.uint8)
        for b in batches:
            hits = np.logical_and.reduce([bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in _places(b.column("hi").to_numpy(), bits)]) if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(hits.astype(bool)))

    return pairs.mapInArrow(pick, pairs.schema)


def drops(docs: DataFrame) -> DataFrame:
    """(id, gone): by document, the digests of the lines it loses, as an array of (hi, lo)."""
    pairs = stash(docs.select("doc_id", "text").mapInArrow(_pairs, "id long, hi long, lo long"), "lines")
    rows = stash(suspects(pairs), "suspects")
    owners = rows.groupBy("hi", "lo").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner < last")
    owners = stash(owners, "owners")  # so that the join deals both sides anew and may split a line that very many documents hold
    lost = rows.join(owners, ["hi", "lo"]).filter("id > owner")
    return lost.groupBy("id").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace text (second column) by what is kept; add the two counts. The last column has the digests to drop."""
    for b in batches:
        keep = [i for i, f in enumerate(b.schema.names) if f not in ("__l_text", "__l_gone")]
        names = [*(b.schema.names[i] for i in keep), "__l_kept", "__l_lines", "__l_dropped"]
        lists = b.column("__l_gone")
        hi, lo = (lists.values.field(k).to_numpy() for k in ("hi", "lo"))
        ends = lists.offsets.to_numpy()
        done, held, texts, n, gone_n = 0, 0, [], [], []
        for row, t in enumerate(_bytes(b.column("__l_text"))):
            lines = t.split(b"\n")
            n.append(len(lines))
            if ends[row] < ends[row + 1] and lists[row].is_valid:
                gone = _digests(hi[ends[row]:ends[row + 1]], lo[ends[row]:ends[row + 1]])
                lines = [x for x in lines if (k := key_of(x)) is None or _digest(k) not in gone]
            gone_n.append(n[-1] - len(lines))
            texts.append(b"\n".join(lines))
            held += len(texts[-1])
            if held >= HELD_BYTES or row == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(done, len(n)) for i in keep), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone_n, pa.int64())], names)
                done, held, texts, n, gone_n = row + 1, 0, [], [], []


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with __l_kept (the text that stays), __l_lines and __l_dropped in place of text."""
    gone = drops(docs).toDF("__l_id", "__l_gone")
    d = docs.withColumnRenamed("text", "__l_text")
    d = d.join(gone, d["doc_id"] == gone["__l_id"], "left").drop("__l_id")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name not in ("__l_text", "__l_gone")]
    return d.mapInArrow(_apply, ", ".join([*schema, "__l_kept string", "__l_lines long", "__l_dropped long"]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines removed; n_chars, if there, is brought up to date."""
    others = [c for c in docs.columns if c != "text"]
    d = line_dedup(docs.select("doc_id", "text", F.struct(*others).alias("row")))
    new = {"text": F.col("__l_kept"), "n_chars": F.length("__l_kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in others else None}
    return d.select(*(new[c].alias(c) if new.get(c) is not None else F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("__l_lines").alias("n_lines"), F.col("__l_dropped").alias("n_dropped"), F.sha2("__l_kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, pos, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n
           FROM (SELECT doc_id, row_number() OVER () AS pos, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.*, coalesce(k.doc_id > o.owner, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, pos
"""

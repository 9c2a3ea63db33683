"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search.

Texts become token ids word by word: the tokenizer never joins across ASCII white space, so the ids of each
different chunk between white space are kept in a dictionary and a text's ids are theirs in turn. Documents longer
than a sequence are cut; only lengths then travel. Pieces are dealt by hash into groups of about GROUP
pieces, each packed on its own: a first fill by best fit in the order of the pieces' digests, then local search that moves a piece, or exchanges
one or two for one, between underfull bins whenever the sum of squared fills grows, so that the emptiest bins drain. A group can waste
less than one bin beyond its bound, of some thousand.

Defined cases: a null or empty text is its end token alone; repeated rows are packed each; rows with a null doc_id are packed like
others; a very long text is cut into whole sequences and a rest; an empty table gives an empty result; ties are broken by digest, doc_id and piece.
Only doc_id and text are read, so other columns' names do not matter.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table

CAPACITY, END_ID = 2048, 0
#: Pieces in a group on average; chunks of text whose ids a worker keeps at most.
GROUP, CACHE = 8192, 1_000_000
#: Exchanges that a search makes without emptying a bin, beside one for each underfull bin; tasks that groups are dealt to at most.
PATIENCE, MAX_TASKS = 100, 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[str, tuple] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks whose pieces can be cut here as the tokenizer cuts them: ASCII and the letters of Latin-1, without its contractions and special tokens.
PLAIN = re.compile(r"(?!.*<\|)[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = [chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)]


def _tokenizer(path: str):
    """The tokenizer, and the ids it has given by chunk and by piece of a chunk; kept by each Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path), {}, {}
    return _loaded[path]


def _packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers, the end token last."""
    tok, known, by_piece = _tokenizer(path)
    if len(known) > CACHE or len(by_piece) > CACHE:
        known.clear()
        by_piece.clear()
    model = tok.model
    chunks = [(t or "").encode().split() for t in texts]
    odd = []
    for c in set().union(*chunks):
        if c in known:
            continue
        text = c.decode()
        if not PLAIN.fullmatch(text):
            odd.append(c)
            continue
        ids = b""
        for p in PIECE.findall(text.lower()):
            if (x := by_piece.get(p)) is None:
                x = by_piece[p] = _packed([t.id for t in model.tokenize(p if p.isascii() else "".join(ALPHABET[b] for b in p.encode()))])
            ids += x
        known[c] = ids
    if odd:
        for c, e in zip(odd, tok.encode_batch_fast([c.decode() for c in odd], add_special_tokens=False)):
            known[c] = _packed(e.ids)
    end, get = END_ID.to_bytes(4, "little"), known.__getitem__
    return [b"".join(map(get, c)) + end for c in chunks]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    path = path or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, rows = b.column(0)[at:at + 500].to_pylist(), []
                for i, x in zip(ids, encode(b.column(1)[at:at + 500].to_pylist(), path)):
                    for k in range(0, len(x), 4 * capacity):
                        part = x[k:k + 4 * capacity]
                        rows.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int, order: Iterable[int] | None = None) -> list[list[int]]:
    """Bins of indices: each piece, in the order given or longest first, goes where it leaves least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]) if order is None else order:
        n = lengths[i]
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room - n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Drain the emptiest bins: move a piece, or exchange one or two for one, wherever the sum of squared fills grows most.
    The sum grows strictly and is bounded, so it ends: at the least number of bins that the lengths allow, when nothing makes it grow,
    or after PATIENCE exchanges that emptied no bin, and one more for each underfull bin."""
    if not bins:
        return bins
    bins = [list(b) for b in bins]
    size, home = np.asarray(lengths, np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    fill = np.bincount(home, weights=size, minlength=len(bins)).astype(np.int64)
    least, live = -(-int(fill.sum()) // capacity), sum(map(bool, bins))
    stuck = np.zeros(len(bins), bool)
    since = 0
    while live > least:
        under = (fill > 0) & (fill < capacity)
        todo = np.flatnonzero(under & ~stuck)
        if not len(todo) or since > PATIENCE + np.count_nonzero(under):
            break
        since += 1
        e = int(todo[np.argmin(fill[todo])])
        own = bins[e]
        ones = {int(size[i]): (i,) for i in own}
        twos = {int(size[i] + size[j]): (i, j) for a, i in enumerate(own) for j in own[a + 1:]}
        under[e] = False
        open_bins, back = np.flatnonzero(under), np.flatnonzero(under[home])  # where a piece may go, and what may come for it
        rooms, given = fill[open_bins], (size[back], fill[home[back]])
        best = 0, None
        for n, x in [*ones.items(), *((n, x) for n, x in twos.items() if n not in ones)]:
            # fills f and e become f + gain and e - gain; the sum of squares grows by 2 gain (f - e + gain)
            if len(x) == 1 and len(rooms):  # of two moves each is one
                grown = np.where(rooms + n <= capacity, n * (rooms - fill[e] + n), 0)
                if grown[k := int(np.argmax(grown))] > best[0]:
                    best = int(grown[k]), (int(open_bins[k]), x, None, n)
            if len(back):
                gain = n - given[0]
                grown = np.where((gain > 0) & (given[1] + gain <= capacity), gain * (given[1] - fill[e] + gain), 0)
                if grown[k := int(np.argmax(grown))] > best[0]:
                    best = int(grown[k]), (int(home[back[k]]), x, int(back[k]), int(gain[k]))
        if best[1] is None:
            stuck[e] = True
            continue
        b, x, y, gain = best[1]
        bins[e] = [i for i in own if i not in x] + ([y] if y is not None else [])
        bins[b] = [i for i in bins[b] if i != y] + list(x)
        home[list(x)] = b
        if y is not None:
            home[y] = e
        fill[b] += gain
        fill[e] -= gain
        if not bins[e]:
            live, since = live - 1, 0
        stuck[:] = False
    return [b for b in bins if b]


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int]], tuple[int, int, int]]:
    """(bin, offset) of each piece, and the numbers of bins before the search, after it, and that the lengths allow at least.
    The search starts from best fit in the order of the pieces; where it ends above the least number, it is tried from
    best fit by descending length as well, and the better packing is taken."""
    least = -(-sum(lengths) // capacity)
    first = best_fit(lengths, capacity, range(len(lengths)))
    bins = local_search(first, lengths, capacity)
    if len(bins) > least:
        bins = min(bins, local_search(best_fit(lengths, capacity), lengths, capacity), key=len)
    out: list = [None] * len(lengths)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            out[i] = k, at
            at += lengths[i]
    return out, (len(first), len(bins), least)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = stash(cut, "pieces")
    groups = max(1, math.ceil(cut.count() / GROUP))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ids_crc32", "doc_id", "piece", "length"], kind="stable").reset_index(drop=True)  # no order of lengths
        placed, _ = pack_group(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = [int(g) * (1 << 32) + k for g, (k, _) in zip(pdf["__k_group"], placed)]
        pdf["offset"] = [at for _, at in placed]
        return pdf.drop(columns="__k_group").astype({"doc_id": "Int64"})

    # the crc spreads copies of one document as well
    dealt = cut.withColumn("__k_group", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)))
    return dealt.repartition(min(groups, MAX_TASKS), "__k_group").groupBy("__k_group").applyInPandas(one, PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity)


def op7_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))

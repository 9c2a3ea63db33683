"""Language identification of mixed text: script ranges, per-word scores, and Viterbi with a switching penalty.

Training counts hashed character n-grams of words by language, on about SAMPLE documents of each language, taken by a hash of their
id. Every label of the training rows is learned: the model has BUCKETS numbers a label (128 kB), and that times the labels is
what the driver collects and broadcasts, whatever the number of documents. The letters' scripts, by code point ranges,
narrow a word's candidates to the languages that use the script in training. Viterbi labels each word, paying PENALTY to change
language between words; the language with the most letters in the labelled spans is the prediction and its share the score.

Batches are cut to about WORDS words times languages. The n-grams of a batch's new words are hashed and scored as arrays; scores of
words are kept from batch to batch and trimmed only between batches. Words of all documents of a batch are walked in
step, place by place, so the path costs a few array operations a place.

Defined cases: a null text, or one without a letter, is und with score 0; so is all text if nothing was learned;
ties go to the first language in order of name; repeated rows are labelled alike; a null doc_id is not
held out and not learned from; an empty table gives an empty result; a very long text is labelled whole, as a batch of its own.
Columns with other names are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

#: Documents of a language to learn from, in expectation; n-gram buckets, as a power of two.
SAMPLE, BUCKET_BITS = 1_000, 15
BUCKETS = 1 << BUCKET_BITS
PENALTY, SMOOTH, LONGEST = 4.0, 0.5, 4
#: A script belongs to a language with at least this share of its letters; a word's loss outside its script.
SCRIPT_SHARE, OUTSIDE = 0.01, 50.0
#: Cells (words times languages) of scores that a worker keeps from batch to batch, that a batch has, about, and that are summed at once.
CACHE, WORDS, CELLS = 1 << 24, 1 << 22, 1 << 22
ASCII, LETTERS = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+")
#: First code point of each range, and its script.
RANGES = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
          (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "other"), (0x20000, "han")]
SCRIPTS = sorted({s for _, s in RANGES})
_starts = np.array([a for a, _ in RANGES])
_script = np.array([SCRIPTS.index(s) for _, s in RANGES])


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    low = (text or "").lower()
    if low.isascii():
        return ASCII.findall(low)
    return [w for x in LETTERS.findall(low) for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


class Words:
    """Some words as arrays of code points, each word between two marks."""

    def __init__(self, words: list[str]):
        self.points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.zeros(0, np.uint32)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def scripts(self) -> np.ndarray:
        return _script[np.searchsorted(_starts, self.points[self.starts + 1], "right") - 1]

    def grams(self) -> Iterator[np.ndarray]:
        """Buckets of the n-grams at each place, for each length: BUCKETS where the word ends first. Last the whole words, at their starts."""
        left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.points))  # places up to the word's end
        h = np.zeros(len(self.points), np.uint64)
        points = self.points.astype(np.uint64) + np.uint64(1)
        for n in range(1, LONGEST + 1):
            h[:len(h) - n + 1] = h[:len(h) - n + 1] * _TIMES + points[n - 1:]
            yield np.where(left >= n, _bucket(h * np.uint64(2 * n + 1)), BUCKETS)
        # powers by place in the word, so that the order of letters counts
        powers = np.cumprod(np.full(int(self.sizes.max(initial=1)), _TIMES, np.uint64))
        whole = np.full(len(self.points), BUCKETS)
        if len(self.starts):
            place = np.arange(len(self.points)) - np.repeat(self.starts, self.sizes)
            whole[self.starts] = _bucket(np.add.reduceat(points * powers[place], self.starts) * np.uint64(2 * LONGEST + 3))
        yield whole


_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) for each batch; the letters of script s have bucket -1 - s."""
    for b in batches:
        words: dict[str, Counter] = {}
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(t))
        for lang, c in words.items():
            if not c:
                continue
            w, n = Words(list(c)), np.fromiter(c.values(), np.float64, len(c))
            each = np.repeat(n, w.sizes)
            found = sum(np.bincount(g, each, BUCKETS + 1) for g in w.grams())[:BUCKETS]
            scripts = np.bincount(w.scripts(), n * (w.sizes - 2), len(SCRIPTS))
            at, s = np.flatnonzero(found), np.flatnonzero(scripts)
            bucket = np.r_[at, -1 - s]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(np.r_[found[at], scripts[s]].astype(np.int64))], ["lang", "bucket", "n"])


class Model:
    """Log scores by bucket and language, and which scripts a language uses. Kept by workers with a cache of word scores."""

    def __init__(self, langs: list[str], weights: np.ndarray, scripts: np.ndarray):
        self.langs, self.weights, self.scripts = langs, weights, scripts  # weights: a row a bucket, and one of zeros
        self._forget()

    def __getstate__(self):
        return self.langs, self.weights, self.scripts

    def __setstate__(self, s):
        self.__init__(*s)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, its best 0."""
        k = len(self.langs)
        out, many = np.empty((len(words), k), np.float32), max(1, CELLS // max(1, 8 * k))
        for lo in range(0, len(words), many):
            w = Words(words[lo:lo + many])
            got = sum(np.add.reduceat(self.weights[g], w.starts, axis=0) for g in w.grams()) * np.float32(2.0 / LONGEST)
            own = self.scripts[:, w.scripts()].T
            got -= np.where(own | ~own.any(axis=1, keepdims=True), np.float32(0), np.float32(OUTSIDE))
            out[lo:lo + many] = got - got.max(axis=1, keepdims=True)
        return out

    def ids(self, docs: list[list[str]]) -> np.ndarray:
        """The words of docs, one after another, as rows of scores; those not seen before are scored first."""
        if self.scores.size > CACHE:
            self._forget()
        new = list(set().union(*docs) - self.known.keys())
        if new:
            at = len(self.scores)
            self.scores = np.concatenate([self.scores, self.score(new)])
            self.known.update(zip(new, range(at, at + len(new))))
        return np.concatenate([np.fromiter(map(self.known.__getitem__, d), np.int64, len(d)) for d in docs])

    def label(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The language of each word of each document, by Viterbi."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        sizes = np.array([len(docs[i]) for i in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = self.ids([docs[i] for i in order])
        k = len(self.langs)
        before, stays = np.empty(len(ids), np.int32), np.empty((len(ids), -(-k // 8)), np.uint8)  # the best language before, and who keeps its own
        score = np.zeros((len(docs), k), np.float32)
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(longest), "left").tolist()  # documents with more words than the place
        for t in range(longest):
            a = alive[t]
            s, at = score[:a], starts[:a] + t
            before[at] = s.argmax(axis=1)
            change = s.max(axis=1, keepdims=True) - np.float32(PENALTY)
            stays[at] = np.packbits(s >= change, axis=1)
            np.maximum(s, change, out=s)
            s += self.scores[ids[at]]
        path, state = np.empty(len(ids), np.int32), score.argmax(axis=1).astype(np.int32)
        for t in range(longest - 1, -1, -1):
            a = alive[t]
            at, now = starts[:a] + t, state[:a]
            path[at] = now
            state[:a] = np.where((stays[at, now >> 3] >> (7 - (now & 7))) & 1, now, before[at])
        out: list = [None] * len(docs)
        for i, s, n in zip(order, starts, sizes):
            out[i] = path[s:s + n]
        return out

    def predict(self, docs: list[list[str]]) -> list[tuple[str, float]]:
        if not docs or not self.langs:
            return [("und", 0.0)] * len(docs)
        found = []
        for words, path in zip(docs, self.label(docs)):
            if not words:
                found.append(("und", 0.0))
                continue
            share = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(self.langs))
            best = int(share.argmax())
            found.append((self.langs[best], float(share[best] / share.sum())))
        return found


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: text and lang. Counts of labels cover all rows; n-grams a sample by hash of about sample documents a language."""
    rows = docs.filter("lang is not null and doc_id is not null")
    sizes = rows.groupBy("lang").count().collect()  # a row a label
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((0, len(SCRIPTS)), bool))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in sizes], "lang string, rate double")
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = rows.join(F.broadcast(rates), "lang").filter(u < F.col("rate")).select("lang", "text")
    counts = part.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n, scripts, at = np.full((BUCKETS + 1, len(langs)), SMOOTH), np.zeros((len(langs), len(SCRIPTS))), {x: i for i, x in enumerate(langs)}
    row, col, val = counts["lang"].map(at).to_numpy(np.int64), counts["bucket"].to_numpy(), counts["n"].to_numpy()
    is_gram = col >= 0
    n[col[is_gram], row[is_gram]] += val[is_gram]
    scripts[row[~is_gram], -1 - col[~is_gram]] = val[~is_gram]
    weights = np.log(n / n[:BUCKETS].sum(axis=0)).astype(np.float32)
    weights[BUCKETS] = 0
    return Model(langs, weights, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; only text is read for a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = max(1, WORDS // max(1, len(model.langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found, part, n = [], [], 0
            for t in b.column(2):
                part.append(words_of(t.as_py()))
                n += len(part[-1])
                if n > most:
                    found += m.predict(part)
                    part, n = [], 0
            found += m.predict(part)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model)

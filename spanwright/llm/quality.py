"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram over character classes, and over the common words of some languages, is
compared with a reference histogram for each language by the Jensen-Shannon distance. The
references are summed over all labelled documents that pass the base rules; a document is rejected when it is far from
every reference, where far in words is relative to a document that has no common word at all. Labels
without listed words get a reference from their own documents, with their most frequent words as
bins, and are judged by that one alone. Words count in any case and without a single mark of punctuation at an end. Short documents are too noisy for that, so each histogram has a least length.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are
judged alike, and one at a threshold stays; a very long text is read whole; an empty table gives an empty result; a language label without a reference (no
document of it is long enough, or the corpus has no labels) leaves the divergence test out, so only the base rules apply; columns of
the input with other names are kept as they are.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash, table, text_of

#: Common function words by language, each a bin of the word histogram.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux nous mais".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta".split(),
}
BINS = sorted({w for words in COMMON.values() for w in words})
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A histogram is compared only from so many characters, or words, on.
MIN_CHARS, MIN_HIST_WORDS = 200, 60
#: Largest distance (base 2, so 0 to 1) to the nearest reference of characters.
MAX_CHAR_DISTANCE = 0.25
#: Largest distance to the nearest reference of words, as a share of the distance that a document without common words has from it:
#: common words are a fifth of a text, so that distance is about 0.33 and not near 1.
MAX_WORD_SHARE = 0.85
#: Bins of a reference that is learned from a label's own documents.
OWN_BINS = 40
#: Punctuation that may stand at a word's ends.
EDGES = ".,;:!?\"'()[]\u00ab\u00bb\u201c\u201d\u201e\u2018\u2019\u2026"
CLASSES = ("letter", "accented", "upper", "digit", "space", "punct", "symbol")
P = "__q_"


def _hash(word: str) -> int:
    """The value of Spark's xxhash64 of a word."""
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


BIN_OF = {_hash(w): i + 1 for i, w in enumerate(BINS)}


def _paired(hashes: Column, step: int) -> Column:
    """Each place's hash combined with the one step places on."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(1 + step), F.greatest(F.size(hashes), F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _plain(w: Column) -> Column:
    """A word in lower case and without a single mark at an end; with more marks it is no plain word and stays as it is."""
    core = F.btrim(w, F.lit(EDGES))
    return F.lower(F.when(F.length(core) >= F.length(w) - 1, core).otherwise(w))


def features(docs: DataFrame) -> DataFrame:
    """docs with the columns __q_*: counts for the base rules and the two histograms. Each step is a column, so that none is
    computed twice; windows of eight words come from pairs of pairs of pairs of word hashes."""
    t = text_of()
    d = docs.withColumn(f"{P}words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumns({
        f"{P}lines": lines,
        f"{P}hashes": F.transform(f"{P}words", lambda w: F.xxhash64(w)),
        f"{P}lowered": F.transform(f"{P}words", lambda w: F.xxhash64(_plain(w))),  # for the histogram only
        f"{P}word_chars": F.length(F.array_join(f"{P}words", "")).cast("long"),
        f"{P}rest": F.regexp_replace(t, r"[a-z\x20]+", ""),  # what the counts of classes look at
        f"{P}n_chars": F.length(t).cast("long"),
    })
    hashes, rest = F.col(f"{P}hashes"), F.col(f"{P}rest")
    count = lambda pattern: F.regexp_count(rest, F.lit(pattern)).cast("long")
    d = d.withColumns({
        f"{P}n_words": F.size(hashes).cast("long"),
        f"{P}n_symbols": count(r"[#*$%&|<>]"),
        f"{P}n_dup_lines": (F.size(f"{P}lines") - F.size(F.array_distinct(f"{P}lines"))).cast("long"),
        f"{P}common": F.sort_array(F.expr(f"filter({P}lowered, h -> h IN ({','.join(f'{h}L' for h in BIN_OF)}))")),
        f"{P}two": F.when(F.size(hashes) >= WINDOW, _paired(hashes, 1)),
        f"{P}accented": count(r"[^\x00-\x7F]"),
        f"{P}upper": count(r"[A-Z]"),
        f"{P}digit": count(r"[0-9]"),
        f"{P}punct": count(r"""[.,;:!?'"()\[\]/_=+@-]"""),
    })
    d = d.withColumn(f"{P}four", _paired(F.col(f"{P}two"), 2))
    d = d.withColumn(f"{P}win", F.slice(_paired(F.col(f"{P}four"), 4), F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))))
    win, common = F.col(f"{P}win"), F.col(f"{P}common")
    # windows found twice: sort (hash, position), keep positions whose hash stands beside them too
    d = d.withColumns({
        f"{P}sorted": F.when(F.size(win) > F.size(F.array_distinct(win)), F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        f"{P}ends": F.filter(F.transform(common, lambda x, j: F.when(F.get(common, j + 1).eqNullSafe(x), -1).otherwise(j)), lambda j: j >= 0),
    })
    srt, ends = F.col(f"{P}sorted"), F.col(f"{P}ends")
    again = F.transform(srt, lambda s, j: F.when(F.get(srt, j - 1)["h"].eqNullSafe(s["h"]) | F.get(srt, j + 1)["h"].eqNullSafe(s["h"]), s["i"]).otherwise(-1))
    number = F.expr("array(" + ",".join(f"{h}L" for h in BIN_OF) + ")")
    d = d.withColumns({
        f"{P}pos": F.sort_array(F.filter(again, lambda i: i >= 0)),
        # (bin, count) for each common word present
        f"{P}hist": F.transform(ends, lambda e, k: F.struct(F.array_position(number, F.get(common, e)).cast("int").alias("bin"), (e - F.coalesce(F.get(ends, k - 1), F.lit(-1))).cast("double").alias("n"))),
    })
    pos = F.col(f"{P}pos")
    covered = F.aggregate(F.transform(pos, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumns({
        f"{P}n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        f"{P}space": F.col(f"{P}n_chars") - F.col(f"{P}word_chars"),
        f"{P}symbol": F.col(f"{P}n_symbols"),
    })
    d = d.withColumns({
        f"{P}failed": (F.col(f"{P}n_words") < MIN_WORDS) | (100 * F.col(f"{P}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{P}n_words")),
        f"{P}letter": F.greatest(F.lit(0), F.col(f"{P}n_chars") - sum((F.col(f"{P}{c}") for c in CLASSES[1:]), F.lit(0))),
    })
    if "lang" in docs.columns:
        d = d.withColumn(f"{P}own", F.when(_other() & ~F.col(f"{P}failed") & (F.col(f"{P}n_words") >= MIN_HIST_WORDS), F.col(f"{P}lowered")))
    return d.drop(*(f"{P}{x}" for x in ("words", "lines", "hashes", "lowered", "rest", "common", "two", "four", "win", "sorted", "pos", "ends")))


def _other() -> Column:
    """The label is none of those with listed words."""
    return ~F.coalesce(F.col("lang").isin(list(COMMON)), F.lit(True))


def references(feats: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """By language: the reference over CLASSES, and over BINS with all other words last. All labelled
    documents that pass the base rules count. At most len(COMMON) rows of fixed length come to the driver."""
    if "lang" not in feats.columns:
        return {}
    good = feats.filter(F.col("lang").isin(list(COMMON)) & ~F.col(f"{P}failed"))
    sums = good.groupBy("lang").agg(F.sum(f"{P}n_words").alias("words"), *(F.sum(f"{P}{c}").alias(c) for c in CLASSES)).collect()
    hist = good.select("lang", F.explode(f"{P}hist").alias("h")).groupBy("lang", F.col("h.bin").alias("bin")).agg(F.sum("h.n").alias("n")).collect()
    out = {}
    for r in sums:
        chars, words = sum(r[c] for c in CLASSES), [0.0] * (len(BINS) + 1)
        for h in hist:
            if h["lang"] == r["lang"]:
                words[h["bin"] - 1] = h["n"] / r["words"]
        words[-1] = 1 - sum(words)
        if chars:
            out[r["lang"]] = [r[c] / chars for c in CLASSES], words
    return out


def own_references(feats: DataFrame) -> DataFrame | None:
    """(lang, __q_ref_chars, __q_ref_words) for each label without listed words that has documents long enough: shares of CLASSES,
    and the most frequent words' hashes with their shares. None if there is no such label."""
    if "lang" not in feats.columns:
        return None
    good = feats.filter(F.col(f"{P}own").isNotNull())
    if good.isEmpty():
        return None
    total = sum((F.sum(f"{P}{c}") for c in CLASSES), F.lit(0))
    sums = good.groupBy("lang").agg(F.array(*(F.sum(f"{P}{c}") / total for c in CLASSES)).alias(f"{P}ref_chars"), F.sum(f"{P}n_words").alias("n"))
    counts = good.select("lang", F.explode(f"{P}own").alias("h")).groupBy("lang", "h").agg(F.count("*").alias("c"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "h"))).filter(F.col("k") <= OWN_BINS)
    words = top.join(sums.select("lang", "n"), "lang").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("h", (F.col("c") / F.col("n")).alias("q")))).alias(f"{P}ref_words"))
    return stash(sums.drop("n").join(words, "lang"), "own-references")


def _term(p: Column, q: float | Column) -> Column:
    """A bin's share of twice the Jensen-Shannon divergence, in bits."""
    q = F.lit(q) if isinstance(q, float) else q
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return part(p) + part(q)


def _char_distance(ref: list[float]) -> Column:
    n = F.greatest(F.col(f"{P}n_chars"), F.lit(1))
    return F.sqrt(F.greatest(F.lit(0.0), sum((_term(F.col(f"{P}{c}") / n, float(q)) for c, q in zip(CLASSES, ref)), F.lit(0.0)) / 2))


def _seen(ref: list[float]) -> Column:
    """Over the common words a document has: twice the divergence, and the sums of both shares."""
    refs = F.expr("array(" + ",".join(f"{max(x, 1e-9):.12f}D" for x in ref[:-1]) + ")")
    pair = F.transform(f"{P}shares", lambda h: F.struct(h["p"].alias("p"), F.get(refs, h["bin"] - 1).alias("q")))
    both = lambda x: x["p"] * F.log2(x["p"]) + x["q"] * F.log2(x["q"]) - (x["p"] + x["q"]) * F.log2((x["p"] + x["q"]) / 2)
    return F.aggregate(pair, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["d"] + both(x)).alias("d"), (a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q")))


def _word_distance(lang: str, ref: list[float]) -> Column:
    seen = F.col(f"{P}seen_{lang}")
    # a bin the document lacks adds the reference's share in full; the last bin holds all other words
    absent = F.greatest(F.lit(0.0), F.lit(float(sum(ref[:-1]))) - seen["q"])
    other = _term(F.greatest(F.lit(0.0), 1 - seen["p"]), float(ref[-1]))
    return F.sqrt(F.greatest(F.lit(0.0), (seen["d"] + absent + other) / 2))


def _bare(ref: list[float]) -> float:
    """The word distance of a document without common words."""
    common, other = sum(ref[:-1]), ref[-1]
    m = (1 + other) / 2
    return math.sqrt(max(0.0, common + math.log2(1 / m) + (other * math.log2(other / m) if other > 0 else 0.0)) / 2) if common > 0 else 0.0


def _nearest(feats: DataFrame, refs: dict) -> DataFrame:
    """feats with the distances to the nearest reference, and the least share of a document without common words."""
    least = lambda xs: xs[0] if len(xs) == 1 else F.least(*xs)
    none = F.lit(None).cast("double")
    n = F.greatest(F.col(f"{P}n_words"), F.lit(1)).cast("double")
    feats = feats.withColumn(f"{P}shares", F.transform(f"{P}hist", lambda h: F.struct(h["bin"].alias("bin"), (h["n"] / n).alias("p"))))
    feats = feats.withColumns({f"{P}seen_{k}": _seen(w) for k, (_, w) in refs.items()})
    known = F.col("lang").isin(list(refs)) | F.col("lang").isNull() if "lang" in feats.columns else F.lit(True)
    chars = F.when(known, least([_char_distance(c) for c, _ in refs.values()])) if refs else none
    feats = feats.withColumns({f"{P}far_{k}": _word_distance(k, w) for k, (_, w) in refs.items()})
    words = F.when(known, least([F.col(f"{P}far_{k}") for k in refs])) if refs else none
    bare = {k: x for k, (_, w) in refs.items() if (x := _bare(w)) > 0}
    share = F.when(known, least([F.col(f"{P}far_{k}") / x for k, x in bare.items()])) if bare else none
    return feats.withColumns({f"{P}char_distance": chars, f"{P}word_distance": words, f"{P}word_share": share})


def _to_own(feats: DataFrame, own: DataFrame) -> DataFrame:
    """The same columns as _nearest, by the reference of a row's own label."""
    d = feats.join(own, "lang", "left")
    chars = F.greatest(F.col(f"{P}n_chars"), F.lit(1))
    far = sum((_term(F.col(f"{P}{c}") / chars, F.get(f"{P}ref_chars", F.lit(i))) for i, c in enumerate(CLASSES)), F.lit(0.0))
    shares = F.expr(f"transform({P}ref_words, w -> named_struct('p', size(filter({P}own, h -> h = w.h)) / double({P}n_words), 'q', w.q))")
    d = d.withColumn(f"{P}pairs", F.when(F.col(f"{P}own").isNotNull(), shares))
    total = lambda of: F.aggregate(F.transform(f"{P}pairs", of), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumns({f"{P}sum_p": total(lambda x: x["p"]), f"{P}sum_q": total(lambda x: x["q"]), f"{P}sum_d": total(lambda x: _term(x["p"], x["q"]))})
    rest = lambda c: F.greatest(F.lit(0.0), 1 - F.col(c))
    root = lambda x: F.sqrt(F.greatest(F.lit(0.0), x / 2))
    word = root(F.col(f"{P}sum_d") + _term(rest(f"{P}sum_p"), rest(f"{P}sum_q")))
    bare = root(F.col(f"{P}sum_q") + _term(F.lit(1.0), rest(f"{P}sum_q")))
    d = d.withColumns({f"{P}char_distance": F.when(F.col(f"{P}ref_chars").isNotNull(), root(far)), f"{P}word_distance": word, f"{P}word_share": F.when(bare > 0, word / bare)})
    return d.drop(*(f"{P}{x}" for x in ("ref_chars", "ref_words", "pairs", "sum_p", "sum_q", "sum_d")))


def verdict(feats: DataFrame, refs: dict, own: DataFrame | None = None) -> DataFrame:
    """feats with __q_char_distance, __q_word_distance (to the nearest reference; null without one) and __q_kept."""
    if own is None:
        d = _nearest(feats, refs)
    else:
        d = _nearest(feats.filter(~_other()), refs).unionByName(_to_own(feats.filter(_other()), own), allowMissingColumns=True)
    far = ((F.col(f"{P}n_chars") >= MIN_CHARS) & (F.col(f"{P}char_distance") > MAX_CHAR_DISTANCE)) | ((F.col(f"{P}n_words") >= MIN_HIST_WORDS) & (F.col(f"{P}word_share") > MAX_WORD_SHARE))
    # always true, but not deterministic to the optimizer: else a filter on this column moves below all steps and repeats them
    here = F.monotonically_increasing_id() >= 0
    return d.withColumn(f"{P}kept", ~F.col(f"{P}failed") & ~F.coalesce(far, F.lit(False)) & here)


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs with their measures and verdict (columns n_words ... kept, distances); one pass over the texts."""
    own = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []))
    feats = stash(features(own).drop("text"), "quality")
    out = verdict(feats, references(feats), own_references(feats))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col(f"{P}{n}").alias(n) for n in names), F.col(f"{P}failed").alias("base_failed"), F.col(f"{P}kept").alias("kept"),
                      F.round(f"{P}char_distance", 6).alias("char_distance"), F.round(f"{P}word_distance", 6).alias("word_distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept. One pass over the texts, whose measures are written beside the whole rows; only rows of labels
    without listed words are joined, to their references."""
    d = docs.select("text", *(["lang"] if "lang" in docs.columns else []), F.struct(*docs.columns).alias(f"{P}row"))
    feats = stash(features(d).drop("text"), "quality")
    return verdict(feats, references(feats), own_references(feats)).filter(f"{P}kept").select(f"{P}row.*")


def op5_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))

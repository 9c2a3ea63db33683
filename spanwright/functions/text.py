"""Text functions over columns. White space is given as explicit classes, as engines differ on the short ones."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code point ranges of wide characters; of ideographs as engines are compared, as reviews look at them, and as sizes do.
WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}\x{FF00}-\x{FFEF}]"
IDEOGRAPH = r"[\x{4E00}-\x{9FFF}]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
CJK_BROAD = r"[\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
SPACE = r"[\x20\x09-\x0D\x{00A0}\x{3000}]"
#: White space of a line's ends, as characters.
WHITE = " \t\n\x0b\x0c\r"
#: Punctuation of CJK text and what it is compared as; units of a number; punctuation that no compact label has; opening bullets.
PUNCTUATION = ("，。：；！？（）【】「」“”‘’／、～", ",.:;!?()[][]\"\"''/,~")
STAT_UNITS = ["亿元", "PB", "MB", "GB", "TB", "分钟", "小时", "亿", "%", "个", "万", "轮", "条", "次", "倍", "年", "月", "天"]
NOT_IN_LABEL = "，。！？；;,:：、/\\()（）[]{}<>《》"
BULLETS = "·•‧∙●○◦▪▫"
#: Dots that look alike, and the one they become.
DOTS, DOT = "\u00b7\u2219\u22c5", "\u2027"
#: Text that a template leaves where content belongs; a report on a file also looks for the first one.
PLACEHOLDERS = ["Click to add", "Lorem ipsum", "Replace with", "TODO", "TBD"]
PLACEHOLDERS_OF_FILES = ["Slide Number", *PLACEHOLDERS]
#: Width of a character as a share of the font size, by class; 1 for others.
WIDTHS = [(r"[\x20\x09\x0B-\x0D\x{00A0}\x{3000}]", 0.35), ("[A-Za-z0-9]", 0.56), (r"[.,:;!|'`]", 0.25), (r"[()\[\]{}（）]", 0.34), ("[-+/=]", 0.45), ("[→←•·‧]", 0.70)]


def wide_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WIDE))


def weighted_length(c: Column) -> Column:
    """Wide characters count two."""
    return F.length(c) + wide_count(c)


def visible_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPACE, ""))


def length_bucket(c: Column) -> Column:
    """By all characters of a text."""
    n = F.length(c)
    return F.when(n <= 4, "short").when(n <= 12, "medium").otherwise("long")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def cjk_dominant(c: Column, ideograph: str = IDEOGRAPH) -> Column:
    """Half of the characters at least."""
    return (c != "") & (2 * F.regexp_count(c, F.lit(ideograph)) >= F.length(c))


def normalise(c: Column) -> Column:
    """What readings of text are compared by: compatibility forms folded (NFKC), white space removed, CJK punctuation as ASCII, lower case
    if all is ASCII. Spark has no NFKC, so this is an Arrow function."""
    return F.pandas_udf(_folded, "string")(c)


def _folded(x: pd.Series) -> pd.Series:
    table = str.maketrans(*PUNCTUATION)

    def one(s):
        s = "".join(unicodedata.normalize("NFKC", s or "").split()).translate(table)
        return s.lower() if s.isascii() else s

    return x.map(one)


def normalise_ascii(c: Column) -> Column:
    """The same in built-in functions, for text that is ASCII."""
    return F.lower(F.regexp_replace(c, r"[\x20\x09-\x0D]", ""))


def _class(chars: str) -> str:
    return "[" + "".join("\\" + x if x in "\\[]^-" else x for x in chars) + "]"


def is_stat_value(c: Column) -> Column:
    """A number with one of the units, of eight visible characters at most."""
    x = F.regexp_replace(c, SPACE, "")
    return (F.length(x) <= 8) & x.rlike("[0-9]") & x.rlike("^[0-9.,+-]+(?:" + "|".join(STAT_UNITS) + ")$")


def compact_label(c: Column) -> Column:
    """A short label of mostly Latin letters without spaces or punctuation."""
    x = F.regexp_replace(c, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    letters = F.regexp_count(x, F.lit("[A-Za-z]"))
    return (F.length(x) <= 16) & ~x.rlike(SPACE) & ~x.rlike(_class(NOT_IN_LABEL)) & (letters >= 2) & (letters >= 0.55 * F.length(x))


def list_prefix(c: Column) -> Column:
    """struct(kind, marker_chars, marker_text, start, auto_type) of what opens a list item, or null. A number that goes on after its point is none."""
    lead = F.length(c) - F.length(F.regexp_replace(c, r"^[\x20\x09-\x0D]+", ""))
    first = F.substring(c, lead + 1, F.lit(1))
    pattern = r"^[\x20\x09-\x0D]*\(?([0-9]{1,3})([.)、．])\)?[\x20\x09-\x0D]*"
    whole, number, suffix = (F.regexp_extract(c, pattern, k) for k in range(3))
    after = F.substring(c, F.length(whole) + 1, F.lit(1))
    made = lambda kind, chars, text, start, auto: F.struct(F.lit(kind).alias("kind"), chars.cast("int").alias("marker_chars"), text.alias("marker_text"), start.cast("int").alias("start"), auto.cast("string").alias("auto_type"))
    bullet = made("bullet", lead + 1, first, F.lit(None), F.lit(None))
    ordered = made("ordered", F.length(whole), whole, number, F.when(suffix == ")", "arabicParenR").otherwise("arabicPeriod"))
    return F.when((first != "") & F.contains(F.lit(BULLETS), first), bullet).when((whole != "") & ~(suffix.isin(".", "．") & after.rlike("[0-9]")), ordered)


def without_bullet(c: Column) -> Column:
    """Text after a leading bullet and its spaces; other text as it is."""
    p = list_prefix(c)
    return F.when(p["kind"] == "bullet", F.regexp_replace(F.substring(c, p["marker_chars"] + 1, F.length(c)), r"^[\x20\x09-\x0D]+", "")).otherwise(c)


def safe_dots(c: Column) -> Column:
    return F.translate(c, DOTS, DOT * len(DOTS))


def is_punctuation(c: Column) -> Column:
    """Nothing visible but punctuation and symbols."""
    return c.rlike(r"^[\p{P}\p{S}\s\x{00A0}\x{3000}]*$")


def has_placeholder(c: Column, words: list[str] = PLACEHOLDERS) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(c, F.lit(w))
    return out


def width_units(c: Column) -> Column:
    """Width of a line in units of the font size, by classes of characters."""
    counts = [(F.regexp_count(c, F.lit(p)), w) for p, w in WIDTHS]
    known = sum((n for n, _ in counts), F.regexp_count(c, F.lit("\n")))
    return F.round(sum((n * w for n, w in counts), F.lit(0.0)) + (F.length(c) - known), 6)


def width_px(c: Column, size: Column, pt_per_px: Column, bold: Column) -> Column:
    """Pixels that the widest line of a text needs."""
    units = F.array_max(F.transform(F.split(c, "\n"), width_units))
    return F.bround(size / pt_per_px * units * 1.10 * F.when(bold, 1.08).otherwise(1.0)).cast("int")


def safe_filename(c: Column) -> Column:
    """The last part of a path without separators and leading dots, or upload if nothing is left."""
    base = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"[\\\x00]", "_")
    clean = F.regexp_replace(F.regexp_replace(base, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"^\.+", "")
    return F.when(clean == "", "upload").otherwise(clean)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def cer(text: Column, reference: Column) -> Column:
    """Edits per character of the reference; 0 for two empty texts."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(text) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(text, reference) / n)


def natural_key(c: Column) -> list[Column]:
    """Numbers first and in order of value, then names."""
    return [F.try_to_number(c, F.lit("9999999999")).isNull(), F.try_to_number(c, F.lit("9999999999")), c]

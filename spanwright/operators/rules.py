"""Rule ladders: the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rounding import clamp, snap


def first_match(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = F.when(*(rules[0][0], F.lit(rules[0][1])))
    for cond, name in rules[1:]:
        out = out.when(cond, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def consensus(engines: dict[str, tuple[str, str]], high: float = 0.95, moderate: float = 0.85, normalise=tx.normalise) -> Column:
    """struct(tier, reason, text) from three engines' texts and confidences, given as columns in order of preference: all empty, all equal once
    normalised, two equal, all within an edit of one another, one of high confidence, the best of moderate confidence, or disagreement.
    The reasons are fixed values."""
    e = [(F.coalesce(F.col(t), F.lit("")), F.coalesce(F.col(p), F.lit(0.0))) for t, p in engines.values()]
    (a, pa), (b, pb), (c, pc) = e
    made = lambda tier, reason, text: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"), text.alias("text"))
    surer = lambda x, y: F.when(F.round(y[1], 4) > F.round(x[1], 4), y[0]).otherwise(x[0])
    ascii_only = lambda x: x.rlike(r"^[\x00-\x7F]*$")

    def top(among: list[Column]) -> tuple[Column, Column]:
        """Text and confidence of the surest engine for which its condition holds, the first of equals."""
        best = F.array_max(F.array(*(F.when(ok, F.struct(p.alias("p"), F.lit(-k).alias("k"), x.alias("x"))) for k, (ok, (x, p)) in enumerate(zip(among, e)))))
        return best["x"], best["p"]

    surest, surest_p = top([a != "", b != "", c != ""])
    surest, surest_p = F.coalesce(surest, a), F.coalesce(surest_p, pa)
    seen = F.when(a != "", a).when(b != "", b).otherwise(c)  # the script is told by the first engine that read anything
    ideographs = tx.cjk_dominant(seen)
    first, third = ideographs & (a != "") & (pa >= 0.30), ~ideographs & ascii_only(seen) & (F.trim(seen) != "") & (c != "") & (pc >= 0.30)
    best = F.when(first, a).when(third, c).otherwise(surest)
    best_p = F.when(first, pa).when(third, pc).otherwise(surest_p)
    over = [(p >= high) & (x != "") for x, p in e]
    longest = F.array_max(F.array(*(F.when(ok, F.struct(F.length(x).alias("n"), F.lit(-k).alias("k"), x.alias("x"))) for k, (ok, (x, _)) in enumerate(zip(over, e)))))["x"]
    among = F.when(tx.cjk_dominant(longest) & over[0], a).when(ascii_only(longest) & over[2], c).otherwise(top(over)[0])

    def ladder(n: Column) -> Column:
        na, nb, nc = n["a"], n["b"], n["c"]
        close = (F.levenshtein(na, nb, 1) >= 0) & (F.levenshtein(na, nc, 1) >= 0) & (F.levenshtein(nb, nc, 1) >= 0)  # -1 beyond one edit; whole distances take the square of a line's length
        return (F.when((na == "") & (nb == "") & (nc == ""), made("green", "C_all_empty", F.lit("")))
                .when((na == nb) & (nb == nc), made("green", "A_strict_consensus", a))
                .when((na == nb) & (na != ""), made("green", "B_majority", surer(e[0], e[1])))
                .when((na == nc) & (na != ""), made("green", "B_majority", surer(e[0], e[2])))
                .when((nb == nc) & (nb != ""), made("green", "B_majority", surer(e[1], e[2])))
                .when((F.least(F.length(na), F.length(nb), F.length(nc)) >= 3) & close, made("yellow", "D_edit_close", best))
                .when(over[0] | over[1] | over[2], made("yellow", "D_prime_single_high_conf", among))
                .when(best_p >= moderate, made("yellow", "G_moderate_conf_fallback", best))
                .otherwise(made("red", "F_disagree", best)))

    return _bound(F.struct(*(normalise(x).alias(k) for k, (x, _) in zip("abc", e))), ladder)


def rescue(tier: Column, reason: Column, suggested: Column, engines: list[Column], crop: Column, crop_p: Column, moderate: float = 0.85, normalise=tx.normalise) -> Column:
    """struct(tier, reason, text) after a second look of the first engine at a red entry. engines: the three texts in order."""
    made = lambda t, r, x: F.struct(t.alias("tier"), r.alias("reason"), x.alias("text"))
    crop = F.coalesce(crop, F.lit(""))
    n, (a, b, c) = normalise(crop), (normalise(F.coalesce(x, F.lit(""))) for x in engines)
    same = made(tier, reason, suggested)
    agrees = lambda name: made(F.lit("yellow"), F.lit(f"G_prime_paddle_crop_agrees_with_{name}"), crop)
    return (F.when((tier != "red") | (n == "") | (n == a), same).when(n == b, agrees("easyocr")).when(n == c, agrees("tesseract"))
            .when(crop_p >= moderate, made(F.lit("yellow"), F.lit("G_prime_paddle_crop_moderate_conf"), crop)).otherwise(same))


#: Words of names and marks that a review clears near a page's edges.
MARK_WORDS = ["UNIVERSITY", "UNNERTY", "INSTITUTE", "COLLEGE", "GROUP", "CORP", "LTD", "INC", "LAB", "LOGO"]


def clearing_rule(text: Column, confidence: Column, x1: Column, y1: Column, x2: Column, y2: Column, page_w: Column, page_h: Column) -> Column:
    """The first of six rules by which recognised text is decoration and no text to edit, or null. The names are fixed values."""
    s = F.btrim(text, F.lit(tx.WHITE))
    n, cjk = F.length(s), s.rlike(tx.CJK)
    rx, ry = (x1 + x2) / 2 / F.greatest(F.lit(1), page_w), (y1 + y2) / 2 / F.greatest(F.lit(1), page_h)
    h = F.greatest(F.lit(1), y2 - y1)
    dots = F.contains(s, F.lit("…"))
    return first_match([
        (((ry < 0.15) | (ry > 0.85) | (rx < 0.16) | (rx > 0.85)) & tx.has_placeholder(text, MARK_WORDS), "H1_logo_strip"),
        ((confidence < 0.55) & (n == 1) & cjk, "H2_single_cjk_lowconf"),
        ((confidence < 0.80) & (n > 0) & (n <= 4) & ~dots & ~s.isin(".", "..") & ~s.rlike(r"[\p{L}\p{N}]"), "H3_punct_symbol_only"),
        ((confidence < 0.90) & (n <= 6) & s.rlike("^[-=>→←↑↓·•]+$"), "H4_arrow_dash_fragment"),
        ((confidence < 0.95) & (h <= 15) & ~((rx > 0.95) & (ry > 0.92)) & (n > 0) & (n <= 8) & ~cjk & ~dots & (s != "."), "H5_short_thin_lowconf"),
        ((confidence < 0.95) & (ry < 0.12) & ((rx > 0.80) | (rx < 0.15)) & (n <= 3) & s.rlike("^[0-9OoDIlZ]{1,3}$"), "H6_logo_digits_top_corner"),
    ])


def cell_style(row: Column, col: Column, rows: Column, text: Column) -> Column:
    """struct(fill, color, bold, align, size) of a table's cell: header, totals, stripes and numbers. The values are fixed."""
    number = (col > 0) & text.rlike("[0-9]")
    head, total = (row == 0) | ((row == rows - 1) & (col == 0)), row == rows - 1
    fill = F.when(head, "#08498D").when(total, "#EEF4FB").when(row % 2 != 0, "#F7FAFE").otherwise("#EEF3FA")
    body = F.when(text.isin("5", "3", "1") & col.isin(1, 4), "#D43E3E").when(text == "0", "#777777").otherwise("#054798")
    color = F.when(head, "#FFFFFF").when(total, F.when(col.isin(1, 2, 4), "#C01818").otherwise("#054798")).when(number, body).when(col == 0, "#666666").otherwise("#222222")
    size = F.when(head, 8).when(total, F.when(number, 18).otherwise(9)).when(number, 16).otherwise(8)
    return F.struct(fill.alias("fill"), color.alias("color"), (head | total | number).alias("bold"), F.when(head | total | (col > 0), "center").otherwise("left").alias("align"), size.alias("size"))


#: Steps of font sizes.
SIZES = [8, 9, 10, 11, 12, 13, 14, 16, 18, 20, 22, 24, 28, 32, 36, 40, 44, 48, 54, 60, 66, 72, 80, 88]


def font_size(text: Column, height: Column, pt_per_px: Column) -> Column:
    """The step nearest to a box's height in points, less what boxes pad by; content ends at 36, only titles over 60 go on."""
    raw = height * pt_per_px * F.when(F.length(text) <= 4, 0.78).when(F.length(text) <= 12, 0.74).otherwise(0.71)
    return snap(F.greatest(F.lit(8.0), F.when(raw > 60, F.least(F.lit(88.0), raw)).otherwise(F.least(F.lit(36.0), raw))), SIZES).cast("int")


def size_step(target_w: Column, target_h: Column, render_w: Column, render_h: Column, text: Column, step: float = 0.06, least: float = 0.012) -> Column:
    """The ratio by which a font size is corrected after a look at what was rendered; 1 if too small to matter."""
    tw, th, rw, rh = (F.greatest(F.lit(1.0), x) for x in (target_w, target_h, render_w, render_h))
    by_h, by_w = clamp(th / rh, 0.35, 2.5), clamp(tw / rw, 0.35, 2.5)
    n = tx.visible_length(text)
    weight = F.when(n <= 4, 0.24).when(n <= 8, 0.18).otherwise(0.12) * F.when(by_w.between(0.92, 1.08), 0.55).otherwise(1.0)
    weight = F.when((th <= 8) | (rh <= 8), F.greatest(weight, F.lit(0.40))).otherwise(weight)
    ratio = clamp(F.exp((1 - weight) * F.log(by_h) + weight * F.log(by_w)), 1 - step, 1 + step)
    return F.when(F.abs(ratio - 1) < least, 1.0).otherwise(ratio)


def shift(delta: Column, most: float = 30.0, dead: float = 0.15) -> Column:
    """A correction of a position, bounded, or 0 within the dead band."""
    x = clamp(delta, -most, most)
    return F.when(F.abs(x) < dead, 0.0).otherwise(x)


def correction(original: Column, corrected: Column) -> Column:
    return first_match([(corrected.isNull(), "skip"), (corrected == original, "confirm"), (corrected == "", "preserve")], "replace")


def terminal_status(canceled: Column, ok: Column) -> Column:
    """Canceled wins, also when the work had ended well."""
    return first_match([(canceled, "canceled"), (ok, "done")], "failed")


#: Measures that are compared with a baseline, and by how much they may fall.
TOLERANCES = {"composite": 0.01, "visual.blurred_match_ratio": 0.02, "visual.color_histogram_sim": 0.03, "text.keyword_recall": 0.01}
#: What parts add to a composite score.
WEIGHTS = {"blurred": 0.30, "histogram": 0.10, "recall": 0.30, "error": 0.20, "counts": 0.10}


def regression(now: dict[str, Column], base: dict[str, Column], known: Column, failed: Column) -> Column:
    """The status of measures against a baseline: any that falls by more than its tolerance is a regression, then any that rises by more an improvement."""
    def any_of(test) -> Column:
        out = F.lit(False)
        for k, by in TOLERANCES.items():
            out |= F.coalesce(test(now[k] - base[k], by), F.lit(False))
        return out

    return first_match([(failed, "FAILED"), (~known, "NEW"), (any_of(lambda d, by: d < -by), "REGRESSED"), (any_of(lambda d, by: d > by), "IMPROVED")], "UNCHANGED")


def composite_score(ok: Column, blurred: Column, histogram: Column, recall: Column, error: Column, texts_in: Column, images_in: Column) -> Column:
    """Weighted measures, 0 to 1; 0 where the structure failed. Without an error rate the recall stands in."""
    zero = F.lit(0.0)
    parts = {"blurred": F.coalesce(blurred, zero), "histogram": F.greatest(zero, F.coalesce(histogram, zero)), "recall": F.coalesce(recall, zero), "error": F.coalesce(1.0 - error, recall, zero),
             "counts": F.when(texts_in, 0.5).otherwise(0.0) + F.when(images_in, 0.5).otherwise(0.0)}
    return F.when(ok, F.round(clamp(sum((parts[k] * w for k, w in WEIGHTS.items()), zero), 0.0, 1.0), 4)).otherwise(0.0)


def lifecycle(action: Column, status: Column, active: Column, total: Column, most_active: int, most: int) -> Column:
    """The code that a request about a job gets: 429 and 409 for too many jobs, 409 for a state that does not allow it, else 200 or 201."""
    busy, done = active >= most_active, status.isin("done", "failed", "canceled")
    return (F.when(action == "create", F.when(busy, 429).when(total >= most, 409).otherwise(201))
            .when(action == "retry", F.when(~status.isin("failed", "canceled"), 409).when(busy, 429).otherwise(200)).when(action == "cancel", F.when(done, 409).otherwise(200)))

"""Passes over a slide's texts that depend on their order, so each slide is one group: sizes unified, texts grouped by a leader, colours dealt. Slides are bounded."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.text import STAT_UNITS
from . import groups as passes

#: Ranges of ideographs.
CJK = re.compile("[一-鿿㐀-䶿豈-﫿]")
STAT = re.compile("[0-9.,+-]*[0-9][0-9.,+-]*(?:" + "|".join(STAT_UNITS) + ")")
#: Sizes that later passes measured and that no pass here changes.
MEASURED = ("render_fit", "mixed_runs", "preview_calibrated")


def _rgb(c) -> tuple[int, ...] | None:
    c = (c or "").lstrip("#")
    return tuple(int(c[k:k + 2], 16) for k in (0, 2, 4)) if re.fullmatch("[0-9A-Fa-f]{6}", c) else None


def close(a, b, by: int = 25) -> bool:
    return _close(a, b, _rgb(a), _rgb(b), by)


def _close(a, b, x: tuple | None, y: tuple | None, by: int = 25) -> bool:
    return (a or "") == (b or "") if x is None or y is None else abs(x[0] - y[0]) <= by and abs(x[1] - y[1]) <= by and abs(x[2] - y[2]) <= by


def bucket(text: str) -> str:
    return "short" if len(text) <= 4 else "medium" if len(text) <= 12 else "long"


def unified(texts: list[dict], ratio: float = 1.6) -> list[int]:
    """Sizes after texts of one row, weight, length and colour take the least of their cluster, which never spans more than ratio."""
    part, sizes = list(range(len(texts))), [int(t["size"]) for t in texts]
    low, high = sizes[:], sizes[:]

    def root(i):
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    kind, rgb = [(bool(t["bold"]), bucket(t["text"])) for t in texts], [_rgb(t["color"]) for t in texts]
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if kind[i] != kind[j] or max(sizes[i], sizes[j]) > ratio * max(1, min(sizes[i], sizes[j])):
                continue
            b = texts[j]
            over = max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
            if over < 0.5 * min(a["y2"] - a["y1"], b["y2"] - b["y1"]) or not _close(a["color"], b["color"], rgb[i], rgb[j]):
                continue
            p, q = root(i), root(j)
            least, most = min(low[p], low[q]), max(high[p], high[q])
            if p != q and least > 0 and most / least <= ratio:
                part[p], low[q], high[q] = q, least, most
    return [low[root(i)] for i in range(len(texts))]


def groups(texts: list[dict]) -> list[int]:
    """A group for each text: that of the first text of its kind, close colour, like height and script that leads none other."""
    kind = lambda t: "stat" if len(x := "".join(t.split())) <= 8 and STAT.fullmatch(x) else bucket(t)
    like = [(kind(t["text"]), bool(CJK.search(t["text"]))) for t in texts]
    rgb, tall = [_rgb(t["color"]) for t in texts], [t["y2"] - t["y1"] for t in texts]
    out: list[int | None] = [None] * len(texts)
    lead = 0
    for i, a in enumerate(texts):
        if out[i] is not None:
            continue
        for j, b in enumerate(texts):
            if j == i or out[j] is None and like[i] == like[j] and max(tall[i], tall[j]) <= min(tall[i], tall[j]) * 1.25 and _close(a["color"], b["color"], rgb[i], rgb[j]):
                out[j] = lead
        lead += 1
    return out


def majority_bold(texts: list[dict], of: list[int]) -> list[bool]:
    """A group's weight is that of half its texts or more; a text alone keeps its own."""
    votes: dict[int, list[bool]] = {}
    for t, g in zip(texts, of):
        votes.setdefault(g, []).append(bool(t["bold"]))
    return [bool(t["bold"]) if len(votes[g]) < 2 else 2 * sum(votes[g]) >= len(votes[g]) for t, g in zip(texts, of)]


def colours(texts: list[dict], palette: int = 12) -> list[int]:
    """A number of a palette for each text, unlike that of any whose wide surroundings meet its own: most neighbours first, then from the top left; -1 where the
    palette is used up."""
    def around(t):
        w, h = t["x2"] - t["x1"], t["y2"] - t["y1"]
        mx, my = max(36.0, min(180.0, w * 0.5)), max(36.0, min(150.0, h * 3.5))
        return t["x1"] - mx, t["y1"] - my, t["x2"] + mx, t["y2"] + my

    b = [around(t) for t in texts]
    near = [[j for j in range(len(b)) if j != i and min(b[i][2], b[j][2]) > max(b[i][0], b[j][0]) and min(b[i][3], b[j][3]) > max(b[i][1], b[j][1])] for i in range(len(b))]
    out: list[int | None] = [None] * len(b)
    for i in sorted(range(len(b)), key=lambda i: (-len(near[i]), b[i][1], b[i][0])):
        used = {out[j] for j in near[i]}
        out[i] = next((c for c in range(palette) if c not in used), -1)
    return out


def folded(texts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """texts with unified_size, style_group, group_bold and calibration_colour; sizes that were measured stay out of the first."""
    def one(rows: list[dict]) -> list[tuple]:
        free = [i for i, r in enumerate(rows) if r.get("size_source") not in MEASURED]
        sizes = [int(r["size"]) for r in rows]
        for i, n in zip(free, unified([rows[i] for i in free])):
            sizes[i] = n
        of = groups(rows)
        return list(zip(sizes, of, majority_bold(rows, of), colours(rows)))

    return passes.folded(texts, keys, [order], one, "unified_size long, style_group long, group_bold boolean, calibration_colour long")

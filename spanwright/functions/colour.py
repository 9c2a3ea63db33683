"""Colours as three numbers of 0 to 255, and as text of the form #RRGGBB."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The colours that samples of text snap to.
WHITE, RED, BLUE, BLACK = "#FFFFFF", "#D43E3E", "#054798", "#222222"
#: The distance that two colours of a family may have; other families 45.
REACH = {"white": 38, "black": 38, "blue": 78, "red": 78, "gray": 78}


def reach(family: Column) -> Column:
    out = F.lit(45)
    for name, by in REACH.items():
        out = F.when(family == name, by).otherwise(out)
    return out


class Colour(NamedTuple):
    r: Column
    g: Column
    b: Column

    @staticmethod
    def parse(text: Column) -> Colour:
        """Of text with or without #; null if it is none."""
        digits = F.regexp_extract(text, r"^\s*#*([0-9A-Fa-f]{6})\s*$", 1)
        part = lambda at: F.when(digits != "", F.conv(F.substring(digits, at, 2), 16, 10).cast("int"))
        return Colour(part(1), part(3), part(5))

    @property
    def hex(self) -> Column:
        return F.format_string("#%02X%02X%02X", *(c.cast("int") for c in self))

    @property
    def luminance(self) -> Column:
        return (0.114 * self.b + 0.587 * self.g + 0.299 * self.r).cast("int")

    @property
    def family(self) -> Column:
        r, g, b = self
        high, low = F.greatest(r, g, b), F.least(r, g, b)
        return (F.when(r.isNull() | g.isNull() | b.isNull(), "unknown").when(low >= 225, "white").when(high <= 70, "black").when((r > g + 35) & (r > b + 35), "red")
                .when((b > r + 32) & (b > g + 18), "blue").when(high - low <= 42, "gray").otherwise("other"))

    def distance(self, other: Colour) -> Column:
        """999 if one is unknown."""
        return F.coalesce(F.sqrt(sum(((a - b) * (a - b) for a, b in zip(self, other)), F.lit(0))), F.lit(999.0))

    def close(self, other: Colour, by: int = 25) -> Column:
        """Each channel within by."""
        far = F.greatest(*(F.abs(a - b) for a, b in zip(self, other)))
        return F.coalesce(far <= by, F.lit(False))

    def compatible(self, other: Colour) -> Column:
        """Of one family, and as near as it allows."""
        return (self.family == other.family) & (self.distance(other) <= reach(self.family))

    def canonical(self, ground: Colour) -> Column:
        """The colour of text that samples of this colour on that ground stand for."""
        r, g, b = self
        high, low = F.greatest(r, g, b), F.least(r, g, b)
        return (F.when((ground.luminance < 110) & (self.luminance > 170), WHITE).when((r > g + 30) & (r > b + 30) & (r > 150), RED).when((b > r + 28) & (b > g + 18) & (b > 80), BLUE)
                .when(high < 80, BLACK).when((high < 130) & (high - low < 12), BLACK).otherwise(self.hex))


def spread_hue(slide: Column, text: Column) -> Column:
    """#RRGGBB of a hue that steps by the golden ratio from text to text; saturation .92, value .50."""
    h = F.pmod(0.137 + slide * 0.173 + text * 0.61803398875, F.lit(1.0))
    i = F.floor(h * 6)
    f = h * 6 - i
    v, p = F.lit(0.50), F.lit(0.50 * (1 - 0.92))
    q, t = 0.50 * (1 - 0.92 * f), 0.50 * (1 - 0.92 * (1 - f))
    by_sector = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    channel = lambda k: F.bround(255 * F.get(F.array(*(s[k] for s in by_sector)), F.pmod(i, F.lit(6)).cast("int"))).cast("int")
    return Colour(*(channel(k) for k in range(3))).hex

"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import stash, table

__all__ = ["WORD", "stash", "table", "text_of"]

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))

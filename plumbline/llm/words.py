"""What the text operators call a word, in Spark and in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words (ASCII only), as a Java, RE2 and Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_list(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as a long, without a lambda: pieces of the split that are not empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return (F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("long")


def ascii_lower(data: bytes) -> bytes:
    """A-Z in lower case; every other byte stays (``bytes.lower`` does just that)."""
    return data.lower()


def words_of(data: bytes) -> list[bytes]:
    """The same words in Python: ``bytes.split`` splits at exactly the six ASCII spaces."""
    return data.split()

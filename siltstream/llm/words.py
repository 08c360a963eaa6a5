"""Words of texts as column expressions: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, UNDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def lowered(text: Column) -> Column:
    """A to Z in lower case, every other character as it is (lower() serves where all is ASCII)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UNDER))


def spaced_words(text: Column) -> Column:
    """Words between whitespace; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters a-z, digits and all beyond ASCII; null has none."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")

"""Unicode-aware text expressions made of JVM built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space and as word characters.
# Java's \s and \w cover ASCII only, so the Unicode classes are written out.
SPACE_CHARS = r"\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}"
WORD_CHARS = r"\p{L}\p{N}_"

BLANK_PATTERN = "^[" + SPACE_CHARS + "]*$"


def is_blank(c: Column) -> Column:
    return c.rlike(BLANK_PATTERN)


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def count_chars(c: Column, char_class: str) -> Column:
    """How many characters are in ``char_class``: drop the runs of all others and measure."""
    return F.length(F.regexp_replace(c, "[^" + char_class + "]+", ""))


def word_count(c: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.regexp_count(c, F.lit("[^" + SPACE_CHARS + "]+"))


def non_space_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[" + SPACE_CHARS + "]+", ""))


def uppercase_count(c: Column) -> Column:
    return count_chars(c, "A-Z")


def lowercase_count(c: Column) -> Column:
    return count_chars(c, "a-z")


def punctuation_count(c: Column) -> Column:
    """Characters that are neither word characters nor white space."""
    return F.length(F.regexp_replace(c, "[" + WORD_CHARS + SPACE_CHARS + "]+", ""))


def fixed(c: Column, digits: int) -> Column:
    """A number with a fixed count of decimals; exact ties go to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits))

"""Predicates and cleaning for text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number-like value, a special character and a blank text.
NUMBER_LIKE = r"^-?\d*\.?\d+$"
SPECIAL_CHARACTER = r"[^a-zA-Z0-9\s]"
BLANK = r"(?U)^\s*$"


def clean_text(c: Column) -> Column:
    """Lower case, outer blanks off, inner runs of blanks to one."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def is_number_like(c: Column) -> Column:
    return c.rlike(NUMBER_LIKE)


def has_special_character(c: Column) -> Column:
    return c.rlike("(?U)" + SPECIAL_CHARACTER)


def is_all_upper(c: Column) -> Column:
    """At least one cased letter and no lower-case one."""
    return (c == F.upper(c)) & (c != F.lower(c))


def is_all_lower(c: Column) -> Column:
    """At least one cased letter and no upper-case one."""
    return (c == F.lower(c)) & (c != F.upper(c))


def from_utf8(c: Column) -> Column:
    """Bytes to text; NULL where the bytes are not valid UTF-8."""
    return F.try_validate_utf8(c.cast("string"))

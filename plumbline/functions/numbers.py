"""Numbers held as text, shares and other scalar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks removed from number text, and the words read as true.
CURRENCY_SIGNS = "$£€¥"
TRUE_WORDS = ["true", "yes", "y", "1", "t"]

PLAIN_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
PLAIN_INTEGER = r"^[+-]?[0-9]+$"


def to_double(text: Column) -> Column:
    """Text to double, NULL where it is not a plain number.

    The pattern guards the cast: Spark alone reads ``12d`` as 12 and ``NaN`` as a number.
    """
    bare = F.trim(text)
    return F.when(bare.rlike(PLAIN_NUMBER), bare.try_cast("double"))


def parse_number(text: Column, decimal_places: int | None = None) -> Column:
    """Read number text: ``(x)`` is negative, currency signs, commas and blanks go, ``%`` divides by 100."""
    text = text.cast("string")
    in_brackets = text.startswith("(") & text.endswith(")")
    inner = F.when(in_brackets, text.substr(F.lit(2), F.length(text) - 2)).otherwise(text)
    bare = F.regexp_replace(inner, rf"(?U)[{CURRENCY_SIGNS},\s]", "")
    number = to_double(F.replace(bare, F.lit("%"), F.lit("")))
    number = F.when(in_brackets, -number).otherwise(number)
    number = F.when(bare.contains("%"), number / 100).otherwise(number)
    return number if decimal_places is None else F.round(number, decimal_places)


def parse_flag(text: Column) -> Column:
    """1 for a word that means true, else 0."""
    return F.when(F.lower(F.trim(text.cast("string"))).isin(TRUE_WORDS), 1).otherwise(0)


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """``part`` in percent of ``whole``; NULL when the whole is empty."""
    share = F.try_divide(part * 100, whole)
    return share if digits is None else F.round(share, digits)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)

"""What several operators here share: words, held-out rows, size-checked broadcasts, shipping code."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"

#: Rows that a broadcast may hold. Counted before each one; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def blank_words(text: Column) -> Column:
    """The runs of characters other than ASCII blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if a count shows that it holds at most ``rows`` rows.

    Beyond that nothing is marked and Spark joins by a shuffle, splitting skewed partitions itself.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shipped(*names: str) -> None:
    """Send these modules' functions to the executors by value: the package need not be installed there."""
    for name in (__name__, *names):
        cloudpickle.register_pickle_by_value(sys.modules[name])

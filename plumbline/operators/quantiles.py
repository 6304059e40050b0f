"""Exact quantiles with linear interpolation, for columns of any size.

Spark's ``percentile`` is exact but holds every distinct value of a column in one buffer, which a
large column outgrows. Here each wanted rank is narrowed down instead: a pass counts the rows of the
rank's value range in equal-width buckets and keeps the bucket the rank falls in, with the smallest
and largest value seen there as the next range, until that is one value. A pass is a scan of the wanted columns, grouped by a bounded
number of buckets; what comes back to the driver is one row per rank still open.

The passes run when a function here is called. Each counts the rows of its ranges anew, and it is an
error if they have changed: a frame must give the same rows on every scan (``session.stage`` makes it).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.columns import numeric_columns, one_row_each, value

BUCKETS = 1024
STRIDE = 2 * BUCKETS  # room for a span's buckets in a key

QUARTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class _Range:
    """The values from ``low`` to ``high`` of a column: ``rows`` of them, ``below`` smaller ones."""

    column: str
    low: float
    high: float
    below: int
    rows: int

    @property
    def open(self) -> bool:
        return self.low < self.high


def _extent(df: DataFrame, names: list[str]) -> dict[str, _Range]:
    """The full range of every column that has values."""
    structs = []
    for name in names:
        x = value(df, name).cast("double")
        structs.append(F.struct(F.lit(name), F.min(x), F.max(x), F.count(x)))
    found = one_row_each(df, structs, "column string, low double, high double, rows bigint", 16)
    return {
        row["column"]: _Range(row["column"], row["low"], row["high"], 0, row["rows"])
        for row in found.collect()
        if row["rows"]
    }


def _bucket(x: Column, span: _Range) -> Column:
    """A whole number from 0 to BUCKETS that never falls as x grows, and differs at the two ends."""
    if math.isinf(span.low) or math.isinf(span.high):
        # No width to divide: order by sign and magnitude, infinities in the outer buckets.
        size = F.log1p(F.abs(x)) / math.log1p(1.7976931348623157e308) * (BUCKETS // 2 - 1)
        inner = F.signum(x) * F.floor(size) + BUCKETS // 2
        position = F.when(x == float("-inf"), F.lit(0.0)).when(x == float("inf"), F.lit(float(BUCKETS)))
        return position.otherwise(inner).cast("int")
    # Halving both sides keeps the difference finite for the widest ranges.
    half = span.high / 2 - span.low / 2
    if half == 0:
        # The ends are next to each other, with at most a value between them.
        return F.when(x == span.low, 0).when(x == span.high, 2).otherwise(1)
    above = x / 2 - span.low / 2
    return (above / half * BUCKETS if math.isinf(BUCKETS / half) else above * (BUCKETS / half)).cast("int")


def _entry(x: Column, spans: dict[_Range, int]) -> Column:
    """``key, x`` of one value: the number of its span with its bucket there."""
    key = F.lit(None).cast("long")
    for span, number in spans.items():
        key = F.when(x.between(F.lit(span.low), F.lit(span.high)), number * STRIDE + _bucket(x, span)).otherwise(key)
    return F.struct(key.alias("key"), x.alias("x"))


def _narrow(df: DataFrame, wanted: dict[tuple[str, int], _Range]) -> dict[tuple[str, int], _Range]:
    """One pass over the columns still open: the sub-range of every wanted rank."""
    number = {span: i for i, span in enumerate(dict.fromkeys(wanted.values()))}
    entries = []
    for name in dict.fromkeys(span.column for span in number):
        mine = {span: i for span, i in number.items() if span.column == name}
        entries.append(_entry(value(df, name).cast("double"), mine))
    inside = df.select(F.inline(F.array(*entries))).where("key is not null")
    # One whole number as the key keeps the map of buckets on the fast path.
    counted = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    # The buckets of a span are few.
    span = Window.partitionBy("span")
    counted = counted.withColumn("span", F.floor(F.col("key") / STRIDE).cast("int"))
    counted = counted.withColumns({"upto": F.sum("n").over(span.orderBy("low")), "rows": F.sum("n").over(span)})
    # The wanted ranks of each span, counted from the span's first row.
    ranks = [[rank - span.below for (_, rank), s in wanted.items() if s == span] for span in number]
    hit = F.exists(
        F.element_at(F.lit(ranks), F.col("span") + 1),
        lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto")),
    )
    found = counted.where(hit).select("span", "n", "low", "high", "upto", "rows").collect()
    narrowed = {}
    for (name, rank), span in wanted.items():
        for row in found:
            start = span.below + row["upto"] - row["n"]
            if row["span"] == number[span] and row["rows"] == span.rows and start <= rank < start + row["n"]:
                narrowed[name, rank] = _Range(name, row["low"], row["high"], start, row["n"])
        if (name, rank) not in narrowed:
            raise ValueError(f"column {name!r} has other values than on the scan before; stage the frame first")
    return narrowed


def quantile_values(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    probabilities: Sequence[float] = QUARTILES,
) -> dict[str, list[float | None]]:
    """For each numeric column the exact quantiles, linear between neighbours; None without values."""
    names = numeric_columns(df, columns)
    if not names:
        return {}
    extent = _extent(df, names)
    at: dict[tuple[str, int], _Range] = {}
    for name, span in extent.items():
        for p in probabilities:
            position = (span.rows - 1) * p
            at[name, math.floor(position)] = span
            at[name, math.ceil(position)] = span
    while wanted := {key: span for key, span in at.items() if span.open}:
        at |= _narrow(df, wanted)
    result = {}
    for name in names:
        if name not in extent:
            result[name] = [None] * len(probabilities)
            continue
        result[name] = []
        for p in probabilities:
            position = (extent[name].rows - 1) * p
            low = at[name, math.floor(position)].low
            high = at[name, math.ceil(position)].low
            step = position - math.floor(position)
            between = low if step == 0 or low == high else low + (high - low) * step
            result[name].append(None if math.isnan(between) else between)
    return result


def quartiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, q25, q50, q75`` of numeric columns, exact."""
    rows = [(name, *values) for name, values in quantile_values(df, columns).items()]
    return df.sparkSession.createDataFrame(rows, "column string, q25 double, q50 double, q75 double")


def quartiles_approx(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """As :func:`quartiles` in one scan, each within 1/accuracy of its rank."""
    structs = []
    for name in numeric_columns(df, columns):
        q = F.percentile_approx(value(df, name).cast("double"), list(QUARTILES), accuracy)
        structs.append(F.struct(F.lit(name), q[0], q[1], q[2]))
    return one_row_each(df, structs, "column string, q25 double, q50 double, q75 double")

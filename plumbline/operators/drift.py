"""What changed between two snapshots of a table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import TEXT, as_text, is_long, numeric_columns, pick, stack, text_key, type_of, value
from plumbline.operators.frequencies import KEYS, fetched, row_total
from plumbline.operators.measures import null_profile, numeric_stats

THRESHOLD = 0.1


def check_threshold(threshold: float) -> float:
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return threshold


def common_columns(previous: DataFrame, current: DataFrame) -> list[str]:
    return [n for n in previous.columns if n in current.columns]


def _only_in(a: DataFrame, b: DataFrame) -> list[str]:
    return [n for n in a.columns if n not in b.columns]


def _compared(previous: DataFrame, current: DataFrame, columns: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """The common columns that are numeric on both sides, and the others."""
    both = common_columns(previous, current)
    wanted = both if columns is None else [n for n in pick(previous, columns) if n in both]
    numbers = set(numeric_columns(previous, both)) & set(numeric_columns(current, both))
    return [n for n in wanted if n in numbers], [n for n in wanted if n not in numbers]


def drift_summary(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``previous_rows, current_rows, row_difference, new_columns, missing_columns`` in one row."""
    before = previous.agg(F.count(F.lit(1)).alias("previous_rows"))
    now = row_total(current)
    names = lambda found: F.array(*[F.lit(n) for n in sorted(found)]).cast("array<string>")
    return before.select(
        "previous_rows",
        now.alias("current_rows"),
        (now - F.col("previous_rows")).alias("row_difference"),
        names(_only_in(current, previous)).alias("new_columns"),
        names(_only_in(previous, current)).alias("missing_columns"),
    )


def drift_columns(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``column, change, values``: columns on one side only, with how many values they hold there."""
    sides = [("new", current, _only_in(current, previous)), ("missing", previous, _only_in(previous, current))]
    values = F.col("total_rows") - F.col("null_count")
    return stack(
        [
            null_profile(df, found).select("column", F.lit(change).alias("change"), values.alias("values"))
            for change, df, found in sides
        ]
    )


def drift_numeric(
    previous: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """``column, stat, previous, current, percentage_change`` of each figure that moved by more than the threshold."""
    check_threshold(threshold)
    numbers, _ = _compared(previous, current, columns)

    def figures(df: DataFrame, side: str) -> DataFrame:
        return numeric_stats(df, numbers).unpivot("column", ["mean", "std", "min", "max"], "stat", side)

    # Four rows per column on either side: a broadcast of known size.
    change = F.abs(F.try_divide(F.col("current") - F.col("previous"), F.col("previous")))
    return (
        figures(previous, "previous")
        .join(F.broadcast(figures(current, "current")), ["column", "stat"])
        .withColumn("change", change)
        .where(F.col("change") > threshold)
        .select("column", "stat", "previous", "current", (F.col("change") * 100).alias("percentage_change"))
    )


def _text_like(previous: DataFrame, current: DataFrame, name: str) -> bool:
    """Whether the column's values are compared as texts: they are texts, or of different types."""
    kinds = type_of(previous, name), type_of(current, name)
    return kinds[0] != kinds[1] or isinstance(kinds[0], TEXT)


def _under_each_other(previous: DataFrame, current: DataFrame, name: str) -> DataFrame:
    """``value, is_now`` of both snapshots; of different types, as text."""
    as_is = type_of(previous, name) == type_of(current, name)

    def side(df: DataFrame, is_now: int) -> DataFrame:
        c = value(df, name)
        return df.select((c if as_is else as_text(type_of(df, name), c)).alias("value"), F.lit(is_now).alias("is_now"))

    return side(previous, 0).unionAll(side(current, 1)).where("value is not null")


def _sides(rows: DataFrame) -> DataFrame:
    return rows.groupBy("value").agg(F.sum(1 - F.col("is_now")).alias("before"), F.sum("is_now").alias("now"))


def _both_sides(previous: DataFrame, current: DataFrame, name: str) -> DataFrame:
    """``value, before, now`` for each non-null value of a column, one grouping for both snapshots and all that is read off it.

    The two sides are put under each other and counted together: no join, and a value that fills much
    of a snapshot combines on the map side. Long texts are counted by a key.
    """
    rows = _under_each_other(previous, current, name)
    return _sides(_keyed(rows) if _text_like(previous, current, name) else rows)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", text_key(F.col("value")))


def _picked(previous: DataFrame, current: DataFrame, name: str, wanted: Column, at_most: int = KEYS) -> DataFrame:
    """The rows of :func:`_both_sides` for which ``wanted`` holds, a condition on ``before`` and ``now``, with their whole texts."""
    groups = _both_sides(previous, current, name)
    if not _text_like(previous, current, name):
        return groups.where(wanted)
    # the counts are part of the conditions, so that they stay above the grouping
    long = is_long(F.col("value")) & (F.col("before") + F.col("now") > 0)
    keys = groups.where(F.when(long, wanted)).select(F.col("value").alias("key"))
    rows = _under_each_other(previous, current, name).where(is_long(F.col("value"))).withColumn("key", text_key(F.col("value")))
    return groups.where(F.when(~long, wanted)).unionByName(_sides(fetched(rows, keys, at_most)).where(wanted))


def _shown(previous: DataFrame, current: DataFrame, name: str) -> Column:
    if type_of(previous, name) != type_of(current, name):
        return F.col("value")
    return as_text(type_of(previous, name), F.col("value"))


def drift_categories(previous: DataFrame, current: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, category, change``: values of non-numeric columns that came up or went away."""
    _, others = _compared(previous, current, columns)
    if not others:
        return previous.sparkSession.createDataFrame([], "column string, category string, change string")
    return stack(
        [
            _picked(previous, current, name, (F.col("before") == 0) | (F.col("now") == 0)).select(
                F.lit(name).alias("column"),
                _shown(previous, current, name).alias("category"),
                F.when(F.col("before") == 0, "new").otherwise("missing").alias("change"),
            )
            for name in others
        ]
    )


def drift_distribution(
    previous: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Values on both sides whose share of all rows moved by more than the threshold.

    ``column, category, previous_percentage, current_percentage, difference``.
    """
    check_threshold(threshold)
    _, others = _compared(previous, current, columns)
    if not others:
        return previous.sparkSession.createDataFrame(
            [],
            "column string, category string, previous_percentage double, current_percentage double, difference double",
        )
    rows_before, rows_now = row_total(previous), row_total(current)
    before, now = F.try_divide(F.col("before"), rows_before), F.try_divide(F.col("now"), rows_now)
    moved = (F.col("before") > 0) & (F.col("now") > 0) & (F.abs(now - before) > threshold)
    # shares add up to one on either side: no more values than this can move by the threshold
    most = math.ceil(2 / threshold)
    return stack(
        [
            _picked(previous, current, name, moved, most).select(
                F.lit(name).alias("column"),
                _shown(previous, current, name).alias("category"),
                (before * 100).alias("previous_percentage"),
                (now * 100).alias("current_percentage"),
                ((now - before) * 100).alias("difference"),
            )
            for name in others
        ]
    )

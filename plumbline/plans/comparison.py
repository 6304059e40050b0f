"""The whole comparison of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import stack
from plumbline.operators.drift import (
    THRESHOLD,
    drift_categories,
    drift_columns,
    drift_distribution,
    drift_numeric,
    drift_summary,
)


def compare(previous: DataFrame, current: DataFrame, threshold: float = THRESHOLD) -> dict[str, DataFrame]:
    """``summary, columns, numeric, categories`` and ``distribution`` over the columns both sides have."""
    return {
        "summary": drift_summary(previous, current),
        "columns": drift_columns(previous, current),
        "numeric": drift_numeric(previous, current, threshold=threshold),
        "categories": drift_categories(previous, current),
        "distribution": drift_distribution(previous, current, threshold=threshold),
    }


def comparison(previous: DataFrame, current: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All of :func:`compare` but the summary as one frame: ``part, column, item, before, now, change``.

    ``item`` is the figure or the value concerned, ``change`` the percentage, or ``new`` and ``missing``. What came and
    went and how shares moved are read off one grouping per column, which runs once.
    """
    parts = compare(previous, current, threshold)
    number = lambda name: F.col(name).cast("double")
    nothing = F.lit(None).cast("double")
    return stack(
        [
            parts["columns"].select(F.lit("columns").alias("part"), "column", F.lit("values").alias("item"), nothing.alias("before"), number("values").alias("now"), "change"),
            parts["numeric"].select(
                F.lit("numeric").alias("part"), "column", F.col("stat").alias("item"), number("previous").alias("before"), number("current").alias("now"), F.format_string("%.2f", "percentage_change").alias("change")
            ),
            parts["categories"].select(F.lit("categories").alias("part"), "column", F.col("category").alias("item"), nothing.alias("before"), nothing.alias("now"), "change"),
            parts["distribution"].select(
                F.lit("distribution").alias("part"),
                "column",
                F.col("category").alias("item"),
                number("previous_percentage").alias("before"),
                number("current_percentage").alias("now"),
                F.format_string("%.2f", "difference").alias("change"),
            ),
        ]
    )

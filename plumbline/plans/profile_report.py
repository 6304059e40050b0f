"""The full profile of a table: a summary and one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import percent
from plumbline.operators.columns import pick
from plumbline.operators.correlation import correlations
from plumbline.operators.frequencies import distinct_counts, top_values
from plumbline.operators.measures import numeric_stats, table_summary
from plumbline.operators.quantiles import quartiles


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 0) -> DataFrame:
    """``name, type, count, missing, missing_pct, unique, unique_pct``, and for numbers ``mean, std, min, max, q25, q50, q75``.

    With ``top`` there are also ``top_values``, an array of ``value, count, percentage`` by rank, read off the same groupings.
    The pieces hold a row per column, so they are joined by broadcast.
    """
    names = pick(df, columns)
    types = dict(df.dtypes)
    type_name = F.create_map(*[F.lit(x) for name in names for x in (name, types[name])])
    counted = distinct_counts(df, names).select(
        F.col("column").alias("name"),
        type_name[F.col("column")].alias("type"),
        F.col("rows").alias("count"),
        F.col("nulls").alias("missing"),
        percent(F.col("nulls"), F.col("rows")).alias("missing_pct"),
        F.col("distinct").alias("unique"),
        percent(F.col("distinct"), F.col("rows")).alias("unique_pct"),
    )
    parts = [numeric_stats(df, names), quartiles(df, names)]
    if top:
        listed = F.array_sort(F.collect_list(F.struct("rank", "value", "count", "percentage")))
        entries = F.transform("listed", lambda v: F.struct(*[v[c].alias(c) for c in ("value", "count", "percentage")]))
        ranked = top_values(df, names, top).groupBy("column").agg(listed.alias("listed"))
        parts.append(ranked.select("column", entries.alias("top_values")))
    for part in parts:
        counted = counted.join(F.broadcast(part.withColumnRenamed("column", "name")), "name", "left")
    return counted


def profile_report(df: DataFrame) -> dict[str, DataFrame]:
    """``summary``, ``columns``, ``top_values`` and ``correlations`` of a table."""
    return {
        "summary": table_summary(df),
        "columns": column_profile(df, top=10),
        "top_values": top_values(df),
        "correlations": correlations(df),
    }

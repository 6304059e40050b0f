"""Quality metrics and issues of a table, with optional rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import percent
from plumbline.operators.column_types import narrow_dates, schema_buckets
from plumbline.operators.columns import pick
from plumbline.operators.frequencies import distinct_counts, sample_values, value_counts
from plumbline.operators.issues import quality_issues
from plumbline.operators.nested import flatten
from plumbline.plans.validation import validate_table


def quality_metrics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, bucket, data_type, total_rows, null_count, null_percentage, unique_count, unique_percentage, samples``.

    Counts and samples of a column come from the same grouping, which the engine runs once.
    """
    names = pick(df, columns)
    types = dict(df.dtypes)
    type_name = F.create_map(*[F.lit(x) for name in names for x in (name, types[name])])
    with_null = F.col("distinct") + F.when(F.col("nulls") > 0, 1).otherwise(0)
    counted = distinct_counts(df, names).select(
        "column",
        type_name[F.col("column")].alias("data_type"),
        F.col("rows").alias("total_rows"),
        F.col("nulls").alias("null_count"),
        percent(F.col("nulls"), F.col("rows")).alias("null_percentage"),
        with_null.cast("long").alias("unique_count"),
        percent(with_null, F.col("rows") - F.col("nulls")).alias("unique_percentage"),
    )
    return counted.join(F.broadcast(schema_buckets(df)), "column").join(
        F.broadcast(sample_values(df, names)), "column"
    )


def quality_report(df: DataFrame, rules: Any = None) -> dict[str, DataFrame]:
    """Flatten, read midnight-only times as dates, then ``metrics``, ``value_counts``, ``issues`` and ``rules``."""
    flat = narrow_dates(flatten(df))
    report = {
        "metrics": quality_metrics(flat),
        "value_counts": value_counts(flat),
        "issues": quality_issues(flat),
    }
    if rules is not None:
        report["rules"] = validate_table(df, rules)
    return report

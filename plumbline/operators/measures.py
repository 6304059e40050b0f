"""Per-column measurements that one pass of plain aggregates gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import percent
from plumbline.operators.columns import numeric_columns, one_row_each, pick, row_key, value

# A column is in the first band above the first share, in the second above the second.
COMPLETE_ABOVE = 0.9
PARTIAL_ABOVE = 0.7


def table_shape(df: DataFrame) -> DataFrame:
    """``rows, columns, column_names`` in one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.array(*[F.lit(n) for n in df.columns]).alias("column_names"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, total_rows, null_count, null_percentage``."""
    structs = [F.struct(F.lit(n), F.count(F.lit(1)), F.count_if(value(df, n).isNull())) for n in pick(df, columns)]
    counted = one_row_each(df, structs, "column string, total_rows bigint, null_count bigint")
    return counted.withColumn("null_percentage", percent(F.col("null_count"), F.col("total_rows")))


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, mean, std, min, max`` of numeric columns; the deviation is the sample one."""
    structs = []
    for name in numeric_columns(df, columns):
        x = value(df, name).cast("double")
        structs.append(F.struct(F.lit(name), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)))
    return one_row_each(df, structs, "column string, mean double, std double, min double, max double", 8)


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, completeness, band``: the share of non-null rows, 0 for an empty table."""
    share = F.coalesce(
        F.try_divide(F.col("total_rows") - F.col("null_count"), F.col("total_rows")), F.lit(0.0)
    )
    band = (
        F.when(share > COMPLETE_ABOVE, "success").when(share > PARTIAL_ABOVE, "warning").otherwise("danger")
    )
    return null_profile(df, columns).select("column", share.alias("completeness"), band.alias("band"))


def _row_counts(df: DataFrame) -> DataFrame:
    """``n`` copies and ``empty`` cells of each different row. NULL equals NULL here.

    A row is known by one key, so what is shuffled does not grow with the columns.
    """
    empty = sum((value(df, name).isNull().cast("int") for name in df.columns), F.lit(0))
    keyed = df.select(row_key(df, df.columns).alias("row"), empty.alias("empty"))
    return keyed.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max("empty").alias("empty")).select("n", "empty")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``duplicate_rows, duplicate_rows_pct``: rows beyond the first of each different row."""
    rows, extra = F.sum("n"), F.sum(F.col("n") - 1)
    return _row_counts(df).agg(
        F.coalesce(extra, F.lit(0)).alias("duplicate_rows"),
        percent(extra, rows).alias("duplicate_rows_pct"),
    )


def table_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and duplicate rows with their shares, from one grouping."""
    width = len(df.columns)
    rows, extra = F.sum("n"), F.sum(F.col("n") - 1)
    missing = F.sum(F.col("n") * F.col("empty"))
    zero = F.lit(0)
    return _row_counts(df).agg(
        F.coalesce(rows, zero).alias("rows"),
        F.lit(width).cast("long").alias("columns"),
        F.coalesce(missing, zero).alias("missing_cells"),
        percent(missing, rows * width).alias("missing_cells_pct"),
        F.coalesce(extra, zero).alias("duplicate_rows"),
        percent(extra, rows).alias("duplicate_rows_pct"),
    )

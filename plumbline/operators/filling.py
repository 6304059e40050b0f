"""Fill gaps, scale numbers, tidy text and drop repeated rows.

Whole-table figures (median, mode, mean, deviation) enter the row expressions as literals or scalar
subqueries, so filling and scaling stay narrow: no shuffle of the rows and no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import clean_text
from plumbline.operators.columns import FLOATING, INTEGRAL, col, numeric_columns, of_kind, pick, row_key, text_columns, type_of, value
from plumbline.operators.frequencies import most_frequent
from plumbline.operators.measures import null_profile
from plumbline.operators.quantiles import quantile_values

UNKNOWN = "Unknown"


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*[new[n].alias(n) if n in new else col(n) for n in df.columns])


def _with_gaps(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the columns that miss a value somewhere."""
    gaps = null_profile(df, names).where(F.col("null_count") > 0).collect()
    return [row["column"] for row in gaps]


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become the column's exact median, and the column a double.

    A column without gaps keeps its type and is not touched.
    """
    names = _with_gaps(df, numeric_columns(df, columns))
    return _replace(
        df,
        {
            name: F.coalesce(value(df, name).cast("double"), F.lit(middle).cast("double"))
            for name, (middle,) in quantile_values(df, names, [0.5]).items()
        },
    )


def mode_of(df: DataFrame, name: str) -> Column:
    """The most frequent non-null value as a scalar subquery, the smallest on a tie, else NULL.

    Grouped and cut to one row by the engine: the built-in ``mode`` keeps all values in one buffer.
    """
    return most_frequent(df, name, 1).select("value").scalar()


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing text becomes the column's mode, ``Unknown`` if it has no values; missing flags likewise."""
    new = {n: F.coalesce(col(n), mode_of(df, n), F.lit(UNKNOWN)) for n in text_columns(df, columns)}
    new |= {n: F.coalesce(col(n), mode_of(df, n)) for n in of_kind(df, (T.BooleanType,), columns)}
    return _replace(df, new)


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become the column's mean, and the column a double; others stay as they are."""
    names = _with_gaps(df, numeric_columns(df, columns))
    if not names:
        return df
    means = df.agg(F.struct(*[F.avg(value(df, n).cast("double")).alias(n) for n in names]).alias("s")).scalar()
    return _replace(df, {n: F.coalesce(value(df, n).cast("double"), means[n]) for n in names})


def normalize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers become (x - mean) / population deviation; a constant column only loses its mean."""
    names = numeric_columns(df, columns)
    if not names:
        return df
    x = {n: value(df, n).cast("double") for n in names}
    parts = [F.struct(F.avg(x[n]).alias("mean"), F.stddev_pop(x[n]).alias("std")).alias(n) for n in names]
    stats = df.agg(F.struct(*parts).alias("s")).scalar()
    return _replace(
        df, {n: (x[n] - stats[n]["mean"]) / F.coalesce(F.nullif(stats[n]["std"], F.lit(0.0)), F.lit(1.0)) for n in names}
    )


def standardize_types(df: DataFrame) -> DataFrame:
    """Whole numbers to bigint, other numbers to double, booleans as they are, all else to text."""
    new = {}
    for name in df.columns:
        kind = type_of(df, name)
        if isinstance(kind, INTEGRAL):
            new[name] = col(name).cast("long")
        elif isinstance(kind, FLOATING + (T.DecimalType,)):
            new[name] = value(df, name).cast("double")
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            new[name] = F.to_json(col(name))
        elif not isinstance(kind, T.BooleanType):
            new[name] = col(name).cast("string")
    return _replace(df, new)


def clean_texts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns in lower case, trimmed, with single blanks."""
    return _replace(df, {n: clean_text(col(n)) for n in text_columns(df, columns)})


def dedupe_rows(df: DataFrame, id_column: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of each group of rows that agree on all columns but the id: the one with the lowest id.

    A grouping with ``min`` and not a window: copies combine on the map side, so a group holding a
    large part of the table is never gathered in one task. Rows without an id group like the others.
    """
    (id_column,) = pick(df, [id_column])
    if columns is None:
        keys = [n for n in df.columns if n != id_column]
        kept = df.groupBy(*[col(n) for n in keys]).agg(F.min(col(id_column)).alias(id_column))
        return kept.select(*[col(n) for n in df.columns])
    keys = pick(df, columns)
    # The id orders the struct first, so the smallest struct is the row with the lowest id.
    rest = [n for n in df.columns if n != id_column]
    row = F.struct(col(id_column).isNull().alias("no id"), *[col(n) for n in [id_column, *rest]])
    kept = df.select(row_key(df, keys).alias("key"), row.alias("row")).groupBy("key").agg(F.min("row").alias("row"))
    return kept.select(*[F.col("row").getField(n).alias(n) for n in df.columns])


def clip_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Numbers below ``low`` or above ``high`` move to that bound; missing ones stay missing."""
    (name,) = pick(df, [column])
    c = col(name)
    kind = type_of(df, name)
    if low is not None:
        c = F.when(c < low, F.lit(low).cast(kind)).otherwise(c)
    if high is not None:
        c = F.when(c > high, F.lit(high).cast(kind)).otherwise(c)
    return _replace(df, {name: c})

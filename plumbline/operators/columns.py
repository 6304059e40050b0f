"""Which columns a frame has, by kind, and how their values enter a measurement."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numbers import nan_to_null

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = INTEGRAL + FLOATING + (T.DecimalType,)
TEXT = (T.StringType, T.CharType, T.VarcharType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
WITH_TIME = (T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of exactly this name, also when the name holds dots or blanks."""
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def of_kind(df: DataFrame, kinds: tuple, columns: Sequence[str] | None = None) -> list[str]:
    return [n for n in pick(df, columns) if isinstance(type_of(df, n), kinds)]


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns; a boolean is a category, not a number."""
    return of_kind(df, NUMERIC, columns)


def text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return of_kind(df, TEXT, columns)


def pick(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """The named columns, all if none are named; an unknown name is an error."""
    if columns is None:
        return list(df.columns)
    known = {n.lower(): n for n in df.columns}
    names = []
    for name in columns:
        if name.lower() not in known:
            raise ValueError(f"no column {name!r}; there are {', '.join(df.columns)}")
        names.append(name if name in df.columns else known[name.lower()])
    return names


def value(df: DataFrame, name: str) -> Column:
    """A column's values with NaN read as NULL, and types Spark cannot group turned into JSON text."""
    kind = type_of(df, name)
    if isinstance(kind, FLOATING):
        return nan_to_null(col(name))
    if isinstance(kind, (T.MapType, T.VariantType)):
        return F.to_json(col(name))
    return col(name)


# Longer texts are grouped by their first characters and their digest. Such a key is longer than this itself, so it equals
# no text kept as it is.
LONG_TEXT = 64
PREFIX = 32


def prefix(c: Column) -> Column:
    """The first characters of a text or of its key: in the order of the texts, but for those that agree in them."""
    return F.left(c, F.lit(PREFIX))


def is_long(c: Column) -> Column:
    """Whether a text is known by a key, or a key stands for a text."""
    return F.octet_length(c) > LONG_TEXT


def text_key(c: Column) -> Column:
    """A text as a grouping key of bounded width: itself, or if it is long its beginning and its SHA-256 digest."""
    return F.when(is_long(c), F.concat(prefix(c), F.lit("sha2:"), F.sha2(c, 256))).otherwise(c)


def bounded(df: DataFrame, name: str) -> Column:
    """A column's values as grouping keys of bounded width.

    Texts over 64 bytes, and arrays and structs whose JSON is longer, are replaced by their beginning and their SHA-256 digest,
    so counting how many differ ships a short key for each instead of the whole text.
    """
    c = value(df, name)
    if isinstance(type_of(df, name), T.BinaryType):
        c = F.hex(c)
    elif isinstance(type_of(df, name), (T.ArrayType, T.StructType)):
        c = F.to_json(c)
    elif not isinstance(type_of(df, name), TEXT + (T.MapType, T.VariantType)):
        return c
    return text_key(c)


#: Columns of fixed width that are grouped as they are; more, or texts among them, are known by a digest.
FEW_COLUMNS = 4


def row_key(df: DataFrame, names: Sequence[str]) -> Column:
    """What rows are told apart by: a struct of a few numbers, else the SHA-256 digest of all values, each with its length."""
    kinds = [type_of(df, name) for name in names]
    if len(names) <= FEW_COLUMNS and all(isinstance(k, NUMERIC + TEMPORAL + (T.BooleanType,)) for k in kinds):
        return F.struct(*[value(df, name).alias(f"c{i}") for i, name in enumerate(names)])
    parts = []
    for name, kind in zip(names, kinds):
        c = value(df, name)
        # zero has one text, whatever its sign
        text = as_text(kind, c + F.lit(0).cast(kind) if isinstance(kind, FLOATING) else c)
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256)) if parts else F.lit(b"")


def as_text(kind: T.DataType, c: Column) -> Column:
    """The text shown for a value of the given type."""
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """One frame under the other, paired up evenly so that the plan stays shallow for many columns."""
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return stack(frames[:half]).unionByName(stack(frames[half:]))


def one_row_each(df: DataFrame, rows: Sequence[Column], schema: str, at_once: int = 40) -> DataFrame:
    """Aggregate a frame and return one output row per struct of aggregates.

    ``at_once`` rows share a scan. More would outgrow generated code, and an interpreted aggregate is
    many times slower than a second scan, which reads only the columns it needs.
    """
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    cast_to = f"array<struct<{schema}>>"
    return stack(
        [
            df.agg(F.array(*rows[at : at + at_once]).cast(cast_to).alias("rows")).select(F.inline("rows"))
            for at in range(0, len(rows), at_once)
        ]
    )

"""Nested columns to flat ones."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import from_utf8
from plumbline.operators.columns import col, of_kind, pick, type_of


def _flat(kind: T.DataType, c: Column, name: str, sep: str) -> list[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        flat = []
        for field in kind.fields:
            flat += _flat(field.dataType, c.getField(field.name), f"{name}{sep}{field.name}", sep)
        return flat
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        # A field of an array of structs is the array of that field.
        return [(f"{name}{sep}{field.name}", c.getField(field.name)) for field in kind.elementType.fields]
    if isinstance(kind, T.ArrayType):
        return [(f"{name}{sep}length", F.array_size(c)), (f"{name}{sep}items", c)]
    return [(name, c)]


def flatten(df: DataFrame, columns: Sequence[str] | None = None, sep: str = "_") -> DataFrame:
    """Replace nested columns by flat ones.

    A struct gives a column per field, at any depth; an array of structs an array per field; another
    array its length and its items. The names are ``{column}_{field}``, ``_length`` and ``_items``.
    """
    wanted = set(pick(df, columns))
    flat: list[tuple[str, Column]] = []
    for name in df.columns:
        flat += _flat(type_of(df, name), col(name), name, sep) if name in wanted else [(name, col(name))]
    names = [name for name, _ in flat]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"flattening gives two columns named {', '.join(twice)}")
    return df.select(*[c.alias(name) for name, c in flat])


def _spark_type(found: str | None) -> str | None:
    """The Spark type for what a variant holds: numbers as doubles, values of several types as text."""
    if found in (None, "VOID"):
        return None
    found = re.sub(r"\bOBJECT<", "STRUCT<", re.sub(r"\b(VOID|VARIANT)\b", "STRING", found))
    return re.sub(r"\bDECIMAL\(\d+,\d+\)", "DOUBLE", found)


def _parsed(texts: DataFrame) -> DataFrame:
    """A frame with a column ``text``, with ``json``, the text as a variant, and whether it is an ``object`` or an ``array``.

    Step by step, each on the column before, so that the text is parsed once.
    """
    parsed = texts.withColumn("json", F.try_parse_json("text"))
    parsed = parsed.withColumn("shape", F.schema_of_variant("json"))
    is_a = lambda kind: F.coalesce(F.col("shape").startswith(kind), F.lit(False))
    return parsed.withColumns({"object": is_a("OBJECT"), "array": is_a("ARRAY")}).drop("shape")


def json_schemas(df: DataFrame, column: str) -> tuple[str | None, str | None]:
    """The Spark types that hold every JSON object and every JSON array in a text column, from all its rows; None if there are none."""
    parsed = _parsed(df.select(col(column).alias("text")))
    found = parsed.agg(*[F.schema_of_variant_agg(F.when(F.col(kind), F.col("json"))) for kind in ("object", "array")]).first()
    return _spark_type(found[0]), _spark_type(found[1])


def flatten_json_text(df: DataFrame, column: str, schema: str | None = None, sep: str = "_") -> DataFrame:
    """Flatten a column of JSON text like :func:`flatten`; other text goes to ``{column}_value``.

    Objects and arrays may be mixed: the fields of objects and what an array gives are columns of their own, null for rows of the
    other kind. Where both would give a column of the same name, the arrays' begin with ``{column}_list``. The text is parsed
    once. Without a schema, of objects or arrays, one aggregate over the column finds both.
    """
    (name,) = pick(df, [column])
    kinds = ([schema, None] if not schema.upper().startswith("ARRAY") else [None, schema]) if schema else json_schemas(df, name)
    if kinds == (None, None):
        return df
    others = [col(n) for n in df.columns if n != name]
    parsed = _parsed(df.select(*[c.alias(f"c{i}") for i, c in enumerate(others)], col(name).alias("text")))
    cells = [
        F.when(F.col(shape), F.try_variant_get(F.col("json"), "$", kind)).alias(shape) for shape, kind in zip(("object", "array"), kinds) if kind
    ]
    nested = parsed.select("*", *[c.alias(f"of_{i}") for i, c in enumerate(cells)])
    scalar = F.when(~(F.col("object") | F.col("array")), F.col("text")).alias(f"{name}{sep}value")
    flat: list[tuple[str, Column]] = []
    for i in range(len(cells)):
        found = _flat(type_of(nested, f"of_{i}"), F.col(f"of_{i}"), name, sep)
        if {n for n, _ in flat} & {n for n, _ in found}:
            found = _flat(type_of(nested, f"of_{i}"), F.col(f"of_{i}"), f"{name}{sep}list", sep)
        flat += found
    names = [n for n in df.columns if n != name] + [f"{name}{sep}value"] + [n for n, _ in flat]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"flattening gives two columns named {', '.join(twice)}")
    return nested.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(n for n in df.columns if n != name)], scalar, *[c.alias(n) for n, c in flat])


def decode_bytes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Binary columns read as UTF-8 text."""
    binary = of_kind(df, (T.BinaryType,), columns)
    return df.withColumns({name: from_utf8(col(name)) for name in binary})

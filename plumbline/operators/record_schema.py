"""Check rows against a JSON-Schema style description of a record."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.dates import parse_time_or_serial
from plumbline.functions.numbers import to_double
from plumbline.operators.columns import INTEGRAL, NUMERIC, TEMPORAL, TEXT, as_text, type_of, value
from plumbline.operators.rules import RowCheck, count_checks

#: A name without blanks, quotes or brackets, and a host of at least two labels, the last of letters only.
LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = rf"""^[^\s@"<>(),:;\\\[\]]+@(?:{LABEL}[.])+[A-Za-z]{{2,}}$"""


def _number(kind: T.DataType, c: Column) -> Column:
    return c if isinstance(kind, NUMERIC) else to_double(c.cast("string"))


def _of_type(wanted: str, kind: T.DataType, c: Column) -> Column:
    number = _number(kind, c)
    if wanted == "integer":
        return F.lit(True) if isinstance(kind, INTEGRAL) else number == F.rint(number.cast("double"))
    if wanted == "number":
        return number.isNotNull()
    if wanted == "string":
        return F.lit(isinstance(kind, TEXT + TEMPORAL))
    if wanted == "boolean":
        return F.lit(isinstance(kind, T.BooleanType)) | F.lower(c.cast("string")).isin("true", "false")
    raise ValueError(f"unknown property type {wanted!r}")


def schema_checks(df: DataFrame, schema: Mapping[str, Any]) -> list[RowCheck]:
    """A check for every demand the schema makes; a column that is not there fails on every row it must fill."""
    checks = []

    def check(name: str, demand: str, applies: Column, holds: Column) -> None:
        checks.append(RowCheck(f"{name}.{demand}", demand, name, applies, holds))

    for name in schema.get("required", []):
        there = value(df, name).isNotNull() if name in df.columns else F.lit(False)
        check(name, "required", F.lit(True), there)
    for name, demands in schema.get("properties", {}).items():
        if name not in df.columns:
            continue
        kind, c = type_of(df, name), value(df, name)
        present, shown, number = c.isNotNull(), as_text(kind, c), _number(kind, c)
        if "type" in demands:
            check(name, "type", present, _of_type(demands["type"], kind, c))
        if "minimum" in demands:
            check(name, "minimum", present, number >= demands["minimum"])
        if "maximum" in demands:
            check(name, "maximum", present, number <= demands["maximum"])
        if "minLength" in demands:
            check(name, "minLength", present, F.char_length(shown) >= demands["minLength"])
        if "maxLength" in demands:
            check(name, "maxLength", present, F.char_length(shown) <= demands["maxLength"])
        if demands.get("format") == "email":
            check(name, "format", present, shown.rlike(EMAIL))
        if demands.get("format") == "date-time":
            parsed = c if isinstance(kind, TEMPORAL) else parse_time_or_serial(shown)
            check(name, "format", present, parsed.isNotNull())
    return checks


def schema_check(df: DataFrame, schema: Mapping[str, Any]) -> DataFrame:
    """One result row per demand, in the layout of rule results, from one scan."""
    return count_checks(df, schema_checks(df, schema))

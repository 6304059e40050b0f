"""Arithmetic over columns, written as text, with each column read as a number by its content."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.dates import epoch_seconds, parse_time, parse_time_or_serial, parse_with
from plumbline.functions.numbers import parse_flag, parse_number, to_double
from plumbline.operators.column_types import BOOLEAN_WORDS
from plumbline.operators.columns import NUMERIC, TEMPORAL, TEXT, col, one_row_each, pick, type_of, value


def _modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _floor(a: Column, b: Column) -> Column:
    """The quotient rounded down, as a double: from 2^53 on a double is whole by itself."""
    exact = F.try_divide(a, b).cast("double")
    return F.when(F.abs(exact) < 2.0**53, F.floor(exact).cast("double")).otherwise(exact)


def _power(a: Column, b: Column) -> Column:
    found = F.pow(a, b)
    return F.when(F.abs(found) < float("inf"), found)


_ARITHMETIC = {
    ast.Add: F.try_add,
    ast.Sub: F.try_subtract,
    ast.Mult: F.try_multiply,
    ast.Div: F.try_divide,
    ast.FloorDiv: _floor,
    ast.Mod: _modulo,
    ast.Pow: _power,
}
_COMPARISON = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def _column(node: ast.expr, names: Mapping[str, str], read: Callable[[str], Column], text: str) -> Column:
    if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
        sides = [_column(side, names, read, text) for side in (node.left, node.right)]
        return _ARITHMETIC[type(node.op)](*sides)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = _column(node.operand, names, read, text)
        return -inner if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARISON:
        sides = [_column(side, names, read, text) for side in (node.left, node.comparators[0])]
        return _COMPARISON[type(node.ops[0])](*sides).cast("int")
    if isinstance(node, ast.Name) and node.id in names:
        return read(names[node.id])
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return F.lit(node.value).cast("bigint" if isinstance(node.value, int) else "double")
    raise ValueError(f"{ast.unparse(node)!r} in {text!r} is neither a column, a number nor arithmetic")


def _prepared(text: str, columns: Iterable[str]) -> tuple[ast.expr, dict[str, str]]:
    """The expression with plain names in place of columns, and the column behind each name."""
    names: dict[str, str] = {}
    for name in sorted(columns, key=len, reverse=True):
        if name.isidentifier():
            names[name] = name
            continue
        stand_in = f"__column_{len(names)}"
        replaced = re.sub(rf"`{re.escape(name)}`|(?<!\w){re.escape(name)}(?!\w)", stand_in, text)
        if replaced != text:
            text, names[stand_in] = replaced, name
    text = text.replace("`", "")
    text = re.sub(r"(?<![=<>!])=(?!=)", "==", text)
    try:
        return ast.parse(text.strip(), mode="eval").body, names
    except SyntaxError as error:
        raise ValueError(f"{text!r} is not an arithmetic expression") from error


def columns_in(text: str, columns: Iterable[str]) -> list[str]:
    """The columns an expression uses."""
    tree, names = _prepared(text, columns)
    used = {node.id for node in ast.walk(tree) if isinstance(node, ast.Name)}
    return sorted(names[u] for u in used if u in names)


def text_kinds(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """Whether text columns hold flags, numbers, times, some amounts or neither, tried in this order.

    All values must be of a kind, but one that reads as a number (``$5``) makes a column hold amounts.

    One aggregate without a shuffle of values; a row per column comes back to choose how to read it.
    """
    structs = []
    for name in [n for n in pick(df, sorted(set(columns))) if isinstance(type_of(df, n), TEXT)]:
        c = col(name)
        tests = {
            "boolean": F.lower(c).isin(BOOLEAN_WORDS),
            "numeric": to_double(c).isNotNull(),
            "datetime": parse_time(c).isNotNull(),
        }
        kind = F.when(F.bool_or(parse_number(c).isNotNull()), "amount").otherwise("string")
        for word, holds in reversed(tests.items()):
            kind = F.when(F.bool_and(F.when(c.isNotNull(), holds)), word).otherwise(kind)
        structs.append(F.struct(F.lit(name), kind))
    return {row["column"]: row["kind"] for row in one_row_each(df, structs, "column string, kind string", 8).collect()}


def is_time(df: DataFrame, name: str, kinds: Mapping[str, str]) -> bool:
    return isinstance(type_of(df, name), TEMPORAL) or kinds.get(name) == "datetime"


def as_time(df: DataFrame, name: str, date_format: str | None = None) -> Column:
    if isinstance(type_of(df, name), TEMPORAL):
        return col(name).cast("timestamp_ntz")
    return parse_with(col(name), date_format) if date_format else parse_time_or_serial(col(name))


def as_number(
    df: DataFrame,
    name: str,
    kinds: Mapping[str, str],
    decimal_places: int | None = None,
    date_format: str | None = None,
) -> Column:
    """A column as a number: times as epoch seconds, flags as 1 and 0, text parsed; NULL stays NULL."""
    kind = type_of(df, name)
    if is_time(df, name, kinds):
        return epoch_seconds(as_time(df, name, date_format))
    if isinstance(kind, T.BooleanType):
        return col(name).cast("bigint")
    if isinstance(kind, NUMERIC):
        # Whole numbers of any width are reckoned in 64 bits.
        number = value(df, name).cast("bigint") if isinstance(kind, T.IntegralType) else value(df, name)
        return number if decimal_places is None else F.round(number, decimal_places)
    if kinds.get(name) == "boolean":
        return F.when(col(name).isNotNull(), parse_flag(col(name)))
    return parse_number(col(name), decimal_places)


def expression(
    df: DataFrame,
    text: str,
    decimal_places: int | None = None,
    date_format: str | None = None,
    kinds: Mapping[str, str] | None = None,
) -> Column:
    """The value of an arithmetic expression. Dividing by zero and overflow give NULL."""
    tree, names = _prepared(text, df.columns)
    if kinds is None:
        kinds = text_kinds(df, columns_in(text, df.columns))
    result = _column(tree, names, lambda name: as_number(df, name, kinds, decimal_places, date_format), text)
    return result if decimal_places is None else F.round(result, decimal_places)


def add_expression(df: DataFrame, name: str, text: str, decimal_places: int | None = None) -> DataFrame:
    """Add a column holding the value of an expression."""
    return df.withColumn(name, expression(df, text, decimal_places))


def parse_datetime(df: DataFrame, column: str, date_format: str | None = None) -> Column:
    """A text column as times. A format that fails on more than half of all rows is given up for all known ones."""
    (name,) = pick(df, [column])
    if date_format is None:
        return parse_time_or_serial(col(name))
    strict = parse_with(col(name), date_format)
    failed = df.agg(F.avg(strict.isNull().cast("int")).alias("failed")).scalar()
    return F.when(failed > 0.5, parse_time_or_serial(col(name))).otherwise(strict)


def needs_arithmetic(text: str) -> bool:
    """Whether a rule's second column is an expression and not a name."""
    return bool(re.search(r"[*+\-/%]", text)) and not text.isidentifier()

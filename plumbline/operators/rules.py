"""Declarative rules on a table.

A rule is ``{"expectation_type": ..., "kwargs": {...}, "meta": {...}, "rule_id": ...}``. All rules
that look at one row at a time become counts in a shared aggregate over one scan; only a uniqueness
rule needs a grouping of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_time_or_serial
from plumbline.functions.numbers import percent, to_double
from plumbline.functions.text import BLANK
from plumbline.operators.columns import INTEGRAL, NUMERIC, TEMPORAL, TEXT, as_text, bounded, col, one_row_each, pick, stack, type_of, value
from plumbline.operators.column_types import underscored
from plumbline.operators.expressions import (
    as_number,
    as_time,
    columns_in,
    expression,
    is_time,
    needs_arithmetic,
    text_kinds,
)
from plumbline.operators.frequencies import frequency, kind_counts

NOT_NULL = "expect_column_values_to_not_be_null"
IN_SET = "expect_column_values_to_be_in_set"
MATCH = "expect_column_values_to_match_regex"
NOT_MATCH = "expect_column_values_to_not_match_regex"
BETWEEN = "expect_column_values_to_be_between"
GREATER = "expect_column_values_to_be_greater_than"
LESS = "expect_column_values_to_be_less_than"
PAIR_EQUAL = "expect_column_pair_values_to_be_equal"
UNIQUE = "expect_column_values_to_be_unique"
ROW_COUNT = "expect_table_row_count_to_be_between"
MEAN_BETWEEN = "expect_column_mean_to_be_between"
DATE_PARSEABLE = "expect_column_values_to_be_dateutil_parseable"

CHECKS_AT_ONCE = 24
#: Rows that a broadcast may hold; counted before.
BROADCAST_ROWS = 200_000

RESULT = (
    "rule_id string, expectation_type string, column string, element_count bigint, missing_count bigint,"
    " unexpected_count bigint, unexpected_percent double, observed_value double, success boolean"
)


@dataclass(frozen=True)
class Rule:
    """One rule; ``kwargs`` are its settings and ``meta`` its parsing and rounding options."""

    rule_id: str
    expectation_type: str
    kwargs: Mapping[str, Any]
    meta: Mapping[str, Any] = field(default_factory=dict)

    @property
    def column(self) -> str | None:
        return self.kwargs.get("column", self.kwargs.get("column_A"))


@dataclass(frozen=True)
class RowCheck:
    """A test of one row: on rows where ``applies``, ``holds`` must be true."""

    rule_id: str
    expectation_type: str
    column: str
    applies: Column
    holds: Column
    mostly: float | None = None

    @property
    def fails(self) -> Column:
        return self.applies & ~F.coalesce(self.holds, F.lit(False))


def read_rules(document: Any) -> list[Rule]:
    """Rules from any of the layouts in use: ``{"rules": [...]}``, ``{"expectations": [...]}`` or a bare list.

    A flat entry's settings stand beside its type instead of under ``kwargs``. Missing ids are made up.
    """
    entries = document.get("rules", document.get("expectations", [])) if isinstance(document, Mapping) else document
    rules = []
    for i, entry in enumerate(entries):
        if isinstance(entry, Rule):
            rules.append(entry)
            continue
        own = ("expectation_type", "kwargs", "meta", "rule_id")
        kwargs = {**{k: v for k, v in entry.items() if k not in own}, **entry.get("kwargs", {})}
        rule_id = str(entry.get("rule_id", f"rule_{i + 1}"))
        rules.append(Rule(rule_id, entry["expectation_type"], kwargs, entry.get("meta") or {}))
    return rules


def _bound(kind: Any, c: Column, limit: Any) -> tuple[Column, Column]:
    """A column and a limit in comparable types: text is read as a number beside a number."""
    if isinstance(limit, str) and isinstance(kind, TEMPORAL):
        return c.cast("timestamp_ntz"), F.lit(limit).try_cast("timestamp_ntz")
    if isinstance(limit, str) and isinstance(kind, NUMERIC):
        return c, to_double(F.lit(limit))
    if not isinstance(limit, str) and isinstance(kind, TEXT):
        return to_double(c), F.lit(limit)
    return c, F.lit(limit)


def _within(kind: Any, c: Column, low: Any, high: Any) -> Column:
    holds = F.lit(True)
    if low is not None:
        x, limit = _bound(kind, c, low)
        holds = holds & (x >= limit)
    if high is not None:
        x, limit = _bound(kind, c, high)
        holds = holds & (x <= limit)
    return holds


def _in_set(kind: Any, c: Column, allowed: Iterable[Any]) -> Column:
    """Only members of the column's own kind can match; a text column never equals a number."""
    if isinstance(kind, TEXT):
        same = [v for v in allowed if isinstance(v, str)]
    elif isinstance(kind, NUMERIC):
        same = [v for v in allowed if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)]
    elif isinstance(kind, TEMPORAL):
        c, same = c.cast("timestamp_ntz"), [F.lit(v).try_cast("timestamp_ntz") for v in allowed if v is not None]
    else:
        same = [v for v in allowed if v is not None]
    return c.isin(same) if same else F.lit(False)


def _pair(df: DataFrame, rule: Rule, kinds: Mapping[str, str]) -> tuple[Column, Column]:
    """Where an equality rule applies, and whether it holds there.

    Columns that hold times are compared as times. Of other columns a row's cells are compared as numbers if both read as
    numbers, else as texts. A row is missing only if both its cells are.
    """
    places, date_format = rule.meta.get("decimal_places"), rule.meta.get("date_format")
    (a,) = pick(df, [rule.kwargs["column_A"]])
    right = _right_side(rule)
    if _is_expression(df, rule):
        left, found = as_number(df, a, kinds, places, date_format), expression(df, right, places, date_format, kinds)
        return left.isNotNull() | found.isNotNull(), left == found
    (b,) = pick(df, [right])
    either = value(df, a).isNotNull() | value(df, b).isNotNull()
    times = [is_time(df, n, kinds) for n in (a, b)]
    if any(times) and not all(times):
        return either, F.lit(False)
    left, found = [as_time(df, n, date_format) if all(times) else as_number(df, n, kinds, places, date_format) for n in (a, b)]
    as_texts = as_text(type_of(df, a), value(df, a)) == as_text(type_of(df, b), value(df, b))
    return either, F.when(left.isNotNull() & found.isNotNull(), left == found).otherwise(as_texts)


def _right_side(rule: Rule) -> str:
    other = rule.kwargs.get("value")
    if "column_B" not in rule.kwargs and isinstance(other, Mapping) and "$eval" in other:
        return other["$eval"]
    return rule.kwargs["column_B"]


def _is_expression(df: DataFrame, rule: Rule) -> bool:
    if "column_B" not in rule.kwargs:
        return True
    return rule.kwargs["column_B"] not in df.columns and needs_arithmetic(rule.kwargs["column_B"])


def _row_check(df: DataFrame, rule: Rule, kinds: Mapping[str, str]) -> RowCheck | None:
    """The row test of a rule, or None if the rule is about the table as a whole."""
    kw, kind_of_rule = rule.kwargs, rule.expectation_type
    if kind_of_rule in (UNIQUE, ROW_COUNT, MEAN_BETWEEN) or _by_frame(rule):
        return None

    def check(applies: Column, holds: Column) -> RowCheck:
        return RowCheck(rule.rule_id, kind_of_rule, rule.column, applies, holds, kw.get("mostly"))

    if kind_of_rule == PAIR_EQUAL:
        return check(*_pair(df, rule, kinds))
    if "column" not in kw:
        raise ValueError(f"rule {rule.rule_id!r} ({kind_of_rule}) names no column")
    (name,) = pick(df, [kw["column"]])
    kind, c = type_of(df, name), value(df, name)
    present = c.isNotNull()
    if kind_of_rule == NOT_NULL:
        return check(F.lit(True), present)
    if kind_of_rule == IN_SET:
        return check(present, _in_set(kind, c, kw["value_set"]))
    if kind_of_rule == MATCH:
        return check(present, c.cast("string").rlike(kw["regex"]))
    if kind_of_rule == NOT_MATCH:
        return check(present, ~c.cast("string").rlike(kw["regex"]))
    if kind_of_rule == BETWEEN:
        return check(present, _within(kind, c, kw.get("min_value"), kw.get("max_value")))
    if kind_of_rule in (GREATER, LESS):
        x, limit = _bound(kind, c, kw["value"])
        return check(present, x > limit if kind_of_rule == GREATER else x < limit)
    if kind_of_rule == DATE_PARSEABLE:
        parsed = c if isinstance(kind, TEMPORAL) else parse_time_or_serial(c.cast("string"))
        return check(present, parsed.isNotNull())
    raise ValueError(f"unknown rule type {kind_of_rule!r}")


COUNTED = (
    "rule_id string, expectation_type string, column string, mostly double, rows bigint, applied bigint,"
    " failed bigint"
)


def _judged(counted: DataFrame) -> DataFrame:
    """Result rows from counts. A rule holds if nothing failed, or enough passed, or there was nothing to look at."""
    applied, failed, mostly = F.col("applied"), F.col("failed"), F.col("mostly")
    enough = F.coalesce(F.try_divide(applied - failed, applied) >= mostly, F.lit(True))
    return counted.select(
        "rule_id",
        "expectation_type",
        "column",
        F.col("rows").alias("element_count"),
        (F.col("rows") - applied).alias("missing_count"),
        failed.alias("unexpected_count"),
        percent(failed, applied, None).alias("unexpected_percent"),
        F.lit(None).cast("double").alias("observed_value"),
        F.when(mostly.isNull(), failed == 0).otherwise(enough).alias("success"),
    )


def count_checks(df: DataFrame, checks: Sequence[RowCheck]) -> DataFrame:
    """One result row per check; a couple of dozen checks share one scan and one aggregate."""
    structs = [
        F.struct(
            F.lit(check.rule_id),
            F.lit(check.expectation_type),
            F.lit(check.column),
            F.lit(check.mostly),
            F.count(F.lit(1)),
            F.count_if(check.applies),
            F.count_if(check.fails),
        )
        for check in checks
    ]
    return _judged(one_row_each(df, structs, COUNTED, CHECKS_AT_ONCE))


def _table_checks(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Row count and mean rules, again in one aggregate."""
    rows, structs = F.count(F.lit(1)), []
    for rule in rules:
        low, high = rule.kwargs.get("min_value"), rule.kwargs.get("max_value")
        observed, missing = rows.cast("double"), F.lit(0)
        if rule.expectation_type == MEAN_BETWEEN:
            (name,) = pick(df, [rule.kwargs["column"]])
            x = value(df, name) if isinstance(type_of(df, name), NUMERIC) else to_double(value(df, name))
            observed, missing = F.avg(x.cast("double")), rows - F.count(x)
        holds = F.lit(True)
        if low is not None:
            holds = holds & (observed >= low)
        if high is not None:
            holds = holds & (observed <= high)
        structs.append(
            F.struct(
                F.lit(rule.rule_id),
                F.lit(rule.expectation_type),
                F.lit(rule.column),
                rows,
                missing,
                F.lit(None),
                F.lit(None),
                observed,
                F.coalesce(holds, F.lit(False)),
            )
        )
    return one_row_each(df, structs, RESULT)


def _by_frame(rule: Rule) -> bool:
    """Whether the allowed values of a rule are the rows of a frame, not a list."""
    return rule.expectation_type == IN_SET and isinstance(rule.kwargs["value_set"], (DataFrame, Mapping))


def _keys(df: DataFrame, rule: Rule, name: str) -> tuple[Column, DataFrame]:
    """A column's key, and ``allowed``: the keys of a frame's values, each once, broadcast if a count shows that they are few.

    The frame is one itself, of one column, or ``{"table": ..., "column": ...}`` in the catalogue. As in a list, only values of the
    column's own kind can match: texts texts, numbers numbers.
    """
    found = rule.kwargs["value_set"]
    if isinstance(found, Mapping):
        found = df.sparkSession.table(found["table"]).select(col(found["column"]))
    (other,) = found.columns
    kinds = type_of(df, name), type_of(found, other)
    key, allowed = (bounded(frame, n) for frame, n in ((df, name), (found, other)))
    if all(isinstance(k, NUMERIC) for k in kinds):
        common = "bigint" if all(isinstance(k, INTEGRAL) for k in kinds) else "double"
        key, allowed = key.cast(common), allowed.cast(common)
    elif not any(all(isinstance(k, kind) for k in kinds) for kind in (TEXT, TEMPORAL)) and kinds[0] != kinds[1]:
        allowed = F.lit(None).cast(kinds[0])
    elif isinstance(kinds[0], TEMPORAL):
        key, allowed = key.cast("timestamp_ntz"), allowed.cast("timestamp_ntz")
    keys = found.select(allowed.alias("allowed")).where("allowed IS NOT NULL").distinct()
    return key, F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def _grouped_check(df: DataFrame, rule: Rule, name: str, groups: DataFrame, fails: Column) -> DataFrame:
    """The result row of a rule from ``value, n`` and a test of each group."""
    n, present = F.col("n"), F.col("value").isNotNull()

    def rows_where(holds: Column) -> Column:
        return F.coalesce(F.sum(F.when(holds, n)), F.lit(0).cast("long"))

    counted = groups.agg(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.expectation_type).alias("expectation_type"),
        F.lit(name).alias("column"),
        F.lit(rule.kwargs.get("mostly")).cast("double").alias("mostly"),
        rows_where(F.lit(True)).alias("rows"),
        rows_where(present).alias("applied"),
        rows_where(present & fails).alias("failed"),
    )
    return _judged(counted)


def _unique_check(df: DataFrame, rule: Rule) -> DataFrame:
    """Rows whose value occurs more than once; copies are counted before they are shuffled."""
    (name,) = pick(df, [rule.kwargs["column"]])
    return _grouped_check(df, rule, name, kind_counts(df, name), F.col("n") > 1)


def _frame_check(df: DataFrame, rule: Rule) -> DataFrame:
    """Rows whose value is in no row of a frame.

    The values are counted before they are joined, so what meets the allowed ones is a row per different value, and a value
    that a third of the rows have is one of them.
    """
    (name,) = pick(df, [rule.kwargs["column"]])
    key, allowed = _keys(df, rule, name)
    groups = df.select(key.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    joined = groups.join(allowed, F.col("value") == F.col("allowed"), "left")
    return _grouped_check(df, rule, name, joined, F.col("allowed").isNull())


def _kinds(df: DataFrame, rules: Sequence[Rule]) -> dict[str, str]:
    """What the text columns of the equality rules hold."""
    used: set[str] = set()
    for rule in rules:
        if rule.expectation_type == PAIR_EQUAL:
            right = _right_side(rule)
            used |= set(pick(df, [rule.kwargs["column_A"]]))
            used |= set(columns_in(right, df.columns) if _is_expression(df, rule) else pick(df, [right]))
    return text_kinds(df, used)


def row_checks(df: DataFrame, rules: Sequence[Rule]) -> list[RowCheck]:
    kinds = _kinds(df, rules)
    checks = [_row_check(df, rule, kinds) for rule in rules]
    return [check for check in checks if check is not None]


def validate(df: DataFrame, rules: Any) -> DataFrame:
    """One row per rule: how many rows it looked at, how many failed it, and whether it holds.

    ``unexpected_percent`` is of the rows looked at. A rule with ``mostly`` holds when at least that
    share of them passes. In an equality rule a row counts as missing only if both sides are.
    """
    rules = read_rules(rules)
    checks = row_checks(df, rules)
    table_rules = [r for r in rules if r.expectation_type in (ROW_COUNT, MEAN_BETWEEN)]
    parts = [count_checks(df, checks)] if checks else []
    parts += [_table_checks(df, table_rules)] if table_rules else []
    parts += [_unique_check(df, r) for r in rules if r.expectation_type == UNIQUE]
    parts += [_frame_check(df, r) for r in rules if _by_frame(r)]
    return stack(parts) if parts else df.sparkSession.createDataFrame([], RESULT)


def failing_rows(df: DataFrame, rules: Any) -> DataFrame:
    """The rows that fail a row or uniqueness rule, with ``failed_rules`` naming which.

    Row rules need no shuffle. For a uniqueness rule the values that occur more than once, each one row, and for a set
    given as a frame its values, are joined to the rows: by broadcast if a count shows that they are few. A rule about the whole
    table has no failing rows and is an error.
    """
    rules = read_rules(rules)
    whole = [r.rule_id for r in rules if r.expectation_type in (ROW_COUNT, MEAN_BETWEEN)]
    if whole:
        raise ValueError(f"rules about the whole table have no failing rows: {', '.join(map(str, whole))}")
    marks = [F.when(check.fails, F.lit(check.rule_id)) for check in row_checks(df, rules)]
    marked = df
    for i, rule in enumerate(r for r in rules if r.expectation_type == UNIQUE):
        (name,) = pick(df, [rule.kwargs["column"]])
        again = kind_counts(df, name).where("value IS NOT NULL AND n > 1").select(F.col("value").alias(f"_again_{i}"))
        if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            again = F.broadcast(again)
        marked = marked.join(again, bounded(df, name) == F.col(f"_again_{i}"), "left")
        marks.append(F.when(F.col(f"_again_{i}").isNotNull(), F.lit(rule.rule_id)))
    for i, rule in enumerate(r for r in rules if _by_frame(r)):
        (name,) = pick(df, [rule.kwargs["column"]])
        key, allowed = _keys(df, rule, name)
        marked = marked.join(allowed.withColumnRenamed("allowed", f"_allowed_{i}"), key == F.col(f"_allowed_{i}"), "left")
        marks.append(F.when(key.isNotNull() & F.col(f"_allowed_{i}").isNull(), F.lit(rule.rule_id)))
    failed = F.array_compact(F.array(*marks)).cast("array<string>")
    return marked.select(*[col(c) for c in df.columns], failed.alias("failed_rules")).where(F.size("failed_rules") > 0)


def unexpected_values(df: DataFrame, rules: Any) -> DataFrame:
    """``rule_id, column, value, count``: every value that fails a rule about one column, as text."""
    rules = read_rules(rules)
    parts = []
    for check in row_checks(df, rules):
        if check.column in df.columns:
            parts.append((check.rule_id, check.column, frequency(df.where(check.fails), check.column)))
    for rule in rules:
        if rule.expectation_type == UNIQUE:
            (name,) = pick(df, [rule.kwargs["column"]])
            parts.append((rule.rule_id, name, frequency(df, name).where("value IS NOT NULL AND n > 1")))
        elif _by_frame(rule):
            (name,) = pick(df, [rule.kwargs["column"]])
            key, allowed = _keys(df, rule, name)
            parts.append((rule.rule_id, name, frequency(df.join(allowed, key == F.col("allowed"), "left_anti").where(key.isNotNull()), name)))
    if not parts:
        return df.sparkSession.createDataFrame([], "rule_id string, column string, value string, count bigint")
    shown = lambda name: as_text(type_of(df, name), F.col("value")).alias("value")
    return stack([f.select(F.lit(i).alias("rule_id"), F.lit(n).alias("column"), shown(n), F.col("n").alias("count")) for i, n, f in parts])


def suite_summary(results: DataFrame) -> DataFrame:
    """``evaluated, successful, unsuccessful, success_percent, success`` over the rows of :func:`validate`."""
    evaluated, successful = F.count(F.lit(1)), F.count_if(F.col("success"))
    return results.agg(
        evaluated.alias("evaluated"),
        successful.alias("successful"),
        (evaluated - successful).alias("unsuccessful"),
        percent(successful, evaluated, None).alias("success_percent"),
        (successful == evaluated).alias("success"),
    )


def with_underscores(rules: Any, columns: Iterable[str]) -> list[Rule]:
    """Rules rewritten for a table whose column names had their blanks turned into underscores."""
    spaced = {n: underscored(n) for n in sorted(columns, key=len, reverse=True) if " " in n}

    def renamed(setting: Any) -> Any:
        if isinstance(setting, Mapping):
            return {k: renamed(v) for k, v in setting.items()}
        if isinstance(setting, list):
            return [spaced.get(v, v) if isinstance(v, str) else v for v in setting]
        if not isinstance(setting, str):
            return setting
        for old, new in spaced.items():
            setting = re.sub(rf"`{re.escape(old)}`|(?<!\w){re.escape(old)}(?!\w)", new, setting)
        return setting

    about_columns = ("column", "column_A", "column_B", "column_list", "value")
    return [
        Rule(
            rule.rule_id,
            rule.expectation_type,
            {k: renamed(v) if k in about_columns else v for k, v in rule.kwargs.items()},
            rule.meta,
        )
        for rule in read_rules(rules)
    ]


def not_empty(rule_id: str, column: str) -> list[Rule]:
    """No null and no blank text, as two rules."""
    return [
        Rule(rule_id, NOT_NULL, {"column": column}),
        Rule(f"{rule_id}_blank", NOT_MATCH, {"column": column, "regex": BLANK}),
    ]


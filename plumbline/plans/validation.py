"""Rules on a table whose column names may hold blanks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from plumbline.operators.column_types import rename_spaces
from plumbline.operators.rules import validate, with_underscores


def validate_table(df: DataFrame, rules: Any) -> DataFrame:
    """Blanks in column names become underscores, in the rules too; then one result row per rule."""
    return validate(rename_spaces(df), with_underscores(rules, df.columns))

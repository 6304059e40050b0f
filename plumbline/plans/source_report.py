"""The quality report of a stored table or a file, written out if wanted."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.quality_report import quality_report
from plumbline.session import stage
from plumbline.sources.files import scan_file
from plumbline.sources.reports import write_report
from plumbline.sources.tables import read_table, table_info


def _write(report: dict[str, DataFrame], output: str | None) -> dict[str, DataFrame]:
    for part, frame in report.items() if output else ():
        write_report(frame, f"{output}/{part}")
    return report


def analyze_table(
    spark: SparkSession,
    table: str,
    schema: str | None = None,
    database: str | None = None,
    rules: Any = None,
    output: str | None = None,
) -> dict[str, DataFrame]:
    """The quality report of a catalogue table, with its ``metadata``. With ``output`` each part is written as JSON."""
    df = read_table(spark, table, schema, database)
    return _write({"metadata": table_info(df), **quality_report(df, rules)}, output)


def analyze_file(spark: SparkSession, path: str, rules: Any = None, output: str | None = None) -> dict[str, DataFrame]:
    """The quality report of a CSV or JSON file, parsed once. With ``output`` each part is written as JSON."""
    return _write(quality_report(stage(scan_file(spark, path)), rules), output)

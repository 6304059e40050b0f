"""Reports as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.column_types import json_rows


def write_report(df: DataFrame, path: str) -> None:
    """Each row as one JSON object per line, times in ISO form and gaps as null."""
    json_rows(df).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)

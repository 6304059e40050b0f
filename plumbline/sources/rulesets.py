"""Rule sets as JSON files and as a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules import Rule, read_rules

STORED = "id string, name string, description string, rules string, created_at timestamp, updated_at timestamp"


def as_document(rules: Any) -> str:
    """Rules as the JSON document ``{"rules": [...]}``."""
    entries = [
        {
            "expectation_type": rule.expectation_type,
            "kwargs": dict(rule.kwargs),
            "meta": dict(rule.meta),
            "rule_id": rule.rule_id,
        }
        for rule in read_rules(rules)
    ]
    return json.dumps({"rules": entries})


def _document_frame(spark: SparkSession, rules: Any) -> DataFrame:
    return spark.createDataFrame([(as_document(rules),)], "value string")


def save_rules(spark: SparkSession, rules: Any, path: str) -> None:
    """A rule set as a JSON document below ``path``, on whatever file system the path names."""
    _document_frame(spark, rules).coalesce(1).write.mode("overwrite").text(path)


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """A rule set from a JSON document in any of the known layouts. Rules are settings, so they come to the driver."""
    (document,) = spark.read.option("wholetext", True).text(path).collect()
    return read_rules(json.loads(document["value"]))


def store_rules(spark: SparkSession, rules: Any, path: str, name: str, description: str | None = None) -> str:
    """Append a rule set to the table at ``path`` and return its id."""
    rule_set_id, now = uuid.uuid4().hex, datetime.now(timezone.utc)
    row = (rule_set_id, name, description, as_document(rules), now, now)
    spark.createDataFrame([row], STORED).write.mode("append").parquet(path)
    return rule_set_id


def stored_rules(spark: SparkSession, path: str, rule_set_id: str) -> list[Rule]:
    """The rules of a stored set; none if there is no such set."""
    found = spark.read.schema(STORED).parquet(path).where(F.col("id") == rule_set_id).select("rules").take(1)
    return read_rules(json.loads(found[0]["rules"])) if found else []


def list_rule_sets(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, description, created_at, updated_at``, newest first."""
    return (
        spark.read.schema(STORED)
        .parquet(path)
        .select("id", "name", "description", "created_at", "updated_at")
        .orderBy(F.col("updated_at").desc(), "id")
    )


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """``rule_id, expectation_type, column, kwargs, meta`` of each rule, settings as JSON."""
    rows = [
        (r.rule_id, r.expectation_type, r.column, json.dumps(dict(r.kwargs)), json.dumps(dict(r.meta))) for r in rules
    ]
    return spark.createDataFrame(
        rows, "rule_id string, expectation_type string, column string, kwargs string, meta string"
    )

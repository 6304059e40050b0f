"""Profiles and comparison reports kept over time.

Each kind of report is an append-only Parquet table, partitioned by the data set it is about, so the
latest report of a data set reads that data set's partition only. A report is one row of JSON texts
with an entry per column. The values a comparison found new or missing have no such bound: they are
kept as rows of a table of their own, under the report's id.

Column states lie in a folder per data set and day. The profile of any span of days is a merge of its
states, so a new day means a scan of that day's rows only.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.column_states import STATE, merge_states

PROFILE_FIELDS = "id string, timestamp timestamp, summary string, column_profiles string, created_at timestamp"
ANOMALY_FIELDS = (
    "id string, comparison_date date, summary string, column_anomalies string, new_values string,"
    " missing_values string, created_at timestamp"
)


def as_json_list(df: DataFrame, name: str) -> DataFrame:
    """A small report frame as one row with a JSON array of its rows, in a fixed order."""
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    return df.agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias(name))


def _append(df: DataFrame, path: str, dataset: str, report_id: str) -> str:
    row = df.select(
        F.lit(report_id).alias("id"), "*", F.current_timestamp().alias("created_at"), F.lit(dataset).alias("dataset_name")
    )
    row.write.mode("append").partitionBy("dataset_name").parquet(path)
    return report_id


def store_profile(
    summary: DataFrame, column_profiles: DataFrame, path: str, dataset: str, timestamp: datetime | None = None
) -> str:
    """Append a profile and return its id. Reports hold a row per column, so they are small."""
    at = timestamp or datetime.now(timezone.utc)
    profile = as_json_list(summary, "summary").select(
        F.lit(at).cast("timestamp").alias("timestamp"),
        "summary",
        as_json_list(column_profiles, "column_profiles").scalar().alias("column_profiles"),
    )
    return _append(profile, path, dataset, uuid.uuid4().hex)


def store_anomalies(
    summary: DataFrame,
    column_anomalies: DataFrame,
    categories: DataFrame,
    path: str,
    dataset: str,
    comparison_date: date,
) -> str:
    """Append a comparison report and return its id.

    ``categories`` are the ``column, category, change`` rows of the comparison. The report holds how
    many there are per column. The values are written first, so a report that is there is complete.
    """
    report_id = uuid.uuid4().hex
    on = F.lit(comparison_date).cast("date")
    values = categories.withColumns({"id": F.lit(report_id), "dataset_name": F.lit(dataset), "comparison_date": on})
    values.write.mode("append").partitionBy("dataset_name", "comparison_date").parquet(f"{path}/values")
    kept = anomaly_values(summary.sparkSession, path, dataset, report_id, comparison_date)

    def counts(change: str) -> DataFrame:
        return kept.where(F.col("change") == change).groupBy("column").agg(F.count(F.lit(1)).alias("values"))

    report = as_json_list(summary, "summary").select(
        on.alias("comparison_date"),
        "summary",
        as_json_list(column_anomalies, "column_anomalies").scalar().alias("column_anomalies"),
        as_json_list(counts("new"), "new_values").scalar().alias("new_values"),
        as_json_list(counts("missing"), "missing_values").scalar().alias("missing_values"),
    )
    return _append(report, f"{path}/reports", dataset, report_id)


def anomaly_values(
    spark: SparkSession, path: str, dataset: str, report_id: str, comparison_date: date | None = None
) -> DataFrame:
    """``column, category, change`` of a stored comparison.

    Values lie in a folder per data set and date; with the date given only that folder is read.
    """
    fields = "column string, category string, change string, id string, dataset_name string, comparison_date date"
    of_report = (F.col("dataset_name") == dataset) & (F.col("id") == report_id)
    if comparison_date is not None:
        of_report &= F.col("comparison_date") == F.lit(comparison_date).cast("date")
    return spark.read.schema(fields).parquet(f"{path}/values").where(of_report).select("column", "category", "change")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PROFILE_FIELDS}, dataset_name string").parquet(path)


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ANOMALY_FIELDS}, dataset_name string").parquet(f"{path}/reports")


def latest_per_key(df: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """The row of each key that is greatest by the columns named, in that order.

    A grouping with ``max_by``: only one row per key and task is shuffled, however long a key's history.
    """
    others = [n for n in df.columns if n != key]
    last = F.max_by(F.struct(*others), F.struct(*newest))
    return df.groupBy(key).agg(last.alias("last")).select(key, "last.*").select(*df.columns)


def latest_profile(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    stored = read_profiles(spark, path).where(F.col("dataset_name") == dataset)
    return latest_per_key(stored, "dataset_name", ["timestamp", "created_at", "id"])


def latest_anomalies(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    stored = read_anomalies(spark, path).where(F.col("dataset_name") == dataset)
    return latest_per_key(stored, "dataset_name", ["comparison_date", "created_at", "id"])


def store_states(states: DataFrame, path: str, dataset: str, day: date) -> None:
    """Keep the column states of a day's rows; those of a day that is stored again are replaced."""
    kept = states.withColumns({"dataset_name": F.lit(dataset), "day": F.lit(day).cast("date")})
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_name", "day").parquet(path)


def read_states(spark: SparkSession, path: str, dataset: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The stored column states of a data set, with their ``day``, from the first to the last day; only their folders are read."""
    stored = spark.read.schema(f"{STATE}, dataset_name string, day date").parquet(path).where(F.col("dataset_name") == dataset)
    for bound, keep in ((first, F.col("day") >= F.lit(first).cast("date")), (last, F.col("day") <= F.lit(last).cast("date"))):
        stored = stored.where(keep) if bound is not None else stored
    return stored.drop("dataset_name")


def merged_states(spark: SparkSession, path: str, dataset: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """One state per column of all rows of these days."""
    return merge_states(read_states(spark, path, dataset, first, last).drop("day"))

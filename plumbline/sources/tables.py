"""Catalogue tables: scan, list, describe and ingest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.columns import col, quoted, stack
from plumbline.session import stage
from plumbline.sources.files import scan_csv

#: Rows that a broadcast may hold; counted before.
BROADCAST_ROWS = 200_000

# What to do when the table is there already, and Spark's word for it.
IF_EXISTS = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def _full_name(table: str, schema: str | None = None, database: str | None = None) -> str:
    return ".".join(quoted(part) for part in (database, schema, table) if part)


def read_table(spark: SparkSession, table: str, schema: str | None = None, database: str | None = None) -> DataFrame:
    """All rows of a table; what a query does not use is not read."""
    return spark.table(_full_name(table, schema, database))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_on: str | None = None,
    low: int | None = None,
    high: int | None = None,
    partitions: int = 32,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table of a database server. With a numeric column to split on, the parts are read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if split_on is not None:
        reader = reader.options(
            partitionColumn=split_on, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
        )
    return reader.load()


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """``schema, table`` of the catalogue, all schemas unless one is named."""
    names = [schema] if schema else [d.name for d in spark.catalog.listDatabases()]
    listed = [spark.sql(f"SHOW TABLES IN {quoted(name)}").where("not isTemporary") for name in names]
    return stack([t.selectExpr("namespace AS schema", "tableName AS table") for t in listed])


def table_info(df: DataFrame) -> DataFrame:
    """``position, name, type, nullable`` of a frame's columns."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def write_table(
    df: DataFrame, table: str, if_exists: str = "replace", schema: str | None = None, path: str | None = None
) -> None:
    """Write a frame as a table: ``fail``, ``replace`` or ``append`` if it is there."""
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists must be one of {', '.join(IF_EXISTS)}")
    writer = df.write.mode(IF_EXISTS[if_exists]).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(_full_name(table, schema))


def with_row_numbers(df: DataFrame, name: str = "index") -> DataFrame:
    """Number the rows of a frame read from files, from 0 in file order, without sorting them.

    Rows of a file split stay together, so it is enough to count each split once and start its numbers
    where the splits before it end. The splits, a row each, are added up by ranges of files; only the sums
    of the ranges meet in one task. Counting them is a job that runs when the frame is built.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    placed = df.select("*", *split, F.monotonically_increasing_id().alias("_at"))
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    splits = stage(splits.repartitionByRange("_file", "_start").withColumn("_range", F.spark_partition_id()), "splits")
    ranges = splits.groupBy("_range").agg(F.sum("_rows").alias("_total"))
    earlier = F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")
    ranges = ranges.select("_range", earlier.alias("_earlier"))
    before = F.sum("_rows").over(Window.partitionBy("_range").orderBy("_file", "_start")) - F.col("_rows")
    starts = splits.withColumn("_before", before).join(F.broadcast(ranges), "_range")
    starts = starts.select("_file", "_start", (F.col("_earlier") + F.col("_before") - F.col("_first")).alias("_shift"))
    if splits.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    numbered = placed.join(starts, ["_file", "_start"])
    return numbered.select((F.col("_at") + F.col("_shift")).alias(name), *[col(n) for n in df.columns])


def ingest_csv(
    spark: SparkSession,
    csv_path: str,
    table: str,
    if_exists: str = "replace",
    schema: str | None = None,
    path: str | None = None,
    column_types: str | None = None,
    index: bool = False,
) -> None:
    """A CSV file into a table, if wanted with the row numbers as a first column ``index``."""
    rows = scan_csv(spark, csv_path, column_types)
    write_table(with_row_numbers(rows) if index else rows, table, if_exists, schema, path)

"""File scans and the file inventory."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numbers import PLAIN_INTEGER, to_double
from plumbline.operators.columns import col
from plumbline.session import stage

#: Rows that a broadcast may hold; counted before.
BROADCAST_ROWS = 200_000

# Cells of a CSV file that mean there is no value.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
# Cells that are booleans.
FLAGS = ["true", "false"]


def _inferred(text: DataFrame) -> dict[str, str]:
    """The type of every text column, decided on all rows in one aggregate."""
    tests = []
    for i, name in enumerate(text.columns):
        c = col(name)
        fits = {
            "long": F.trim(c).rlike(PLAIN_INTEGER) & F.trim(c).try_cast("long").isNotNull(),
            "double": to_double(c).isNotNull(),
            "boolean": F.lower(c).isin(FLAGS),
        }
        tests += [F.bool_and(F.when(c.isNotNull(), fit)).alias(f"{kind}{i}") for kind, fit in fits.items()]
        tests.append(F.count(c).alias(f"values{i}"))
    found = text.agg(*tests).first()
    types = {}
    for i, name in enumerate(text.columns):
        fits = [kind for kind in ("long", "double", "boolean") if found[f"{kind}{i}"]]
        types[name] = "double" if not found[f"values{i}"] else (fits or ["string"])[0]
    return types


def _as(kind: str, c: Column) -> Column:
    if kind == "string":
        return c
    return to_double(c) if kind == "double" else F.trim(c).try_cast(kind)


#: A cell in quotes that are closed on its line; quotes inside are doubled. Only at its start does a quote open a cell.
QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"[^,]*+'
OPEN = r'(?:^|,)"'


def _cells(spark: SparkSession, path: str | Sequence[str], multi_line: bool) -> DataFrame:
    """All cells as text, by the names in each file's header.

    One pass over the lines finds the header of every file and, unless records may span lines, a cell whose quote
    is left open, which is an error. A row per different header reaches the driver. If there are several, the files are still
    read in one scan, by place, and each row's names come from a join with the headers, a row per file.
    """
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    left_open = F.regexp_replace("value", QUOTED, "$1").rlike(OPEN)
    per_file = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.max(F.when(left_open, F.col("value"))).alias("open"))
    per_file = stage(per_file, "headers")
    headers = per_file.groupBy("header").agg(F.max("open").alias("open")).orderBy("header").collect()
    broken = [row["open"] for row in headers if row["open"] is not None]
    if broken and not multi_line:
        raise ValueError(f"a quote is left open, set multi_line if cells hold line breaks: {broken[0]!r}")
    if len(headers) < 2:
        return _rows(spark, path, multi_line)
    named = {row["header"]: next(csv.reader([row["header"]])) for row in headers}
    names = next(iter(named.values()))
    if any(sorted(found) != sorted(set(names)) for found in named.values()):
        raise ValueError(f"files of {path} have other columns: {'; '.join(named)}")
    files = per_file.select("file", "header")
    files = F.broadcast(files) if files.count() <= BROADCAST_ROWS else files
    placed = _rows(spark, path, multi_line, [f"c{i}" for i in range(len(names))]).join(files, "file")

    def cell(name: str) -> Column:
        c = F.lit(None).cast("string")
        for header, found in named.items():
            c = F.when(F.col("header") == header, F.col(f"c{found.index(name)}")).otherwise(c)
        return c

    return placed.select(*[cell(n).alias(n) for n in names])


def _rows(spark: SparkSession, path: str | Sequence[str], multi_line: bool, places: Sequence[str] | None = None) -> DataFrame:
    """The cells by the names of the header, or by ``places`` with the ``file`` they are of.

    A row with too few cells has nulls at its end; one with too many is an error.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    names = places or reader.csv(path).columns
    odd = "_row_of_another_width"
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, odd]])
    rows = reader.schema(fields).option("columnNameOfCorruptRecord", odd).csv(path)
    # Cut once more with room for one more cell, which is null only if it isn't there.
    wider = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    extra = F.from_csv(F.col(odd), wider, {"nullValue": "\x00", "escape": '"'})[f"c{len(names)}"]
    too_long = F.raise_error(F.concat(F.lit("more cells than columns: "), F.col(odd))).cast("string")
    last = F.when(F.col(odd).isNotNull() & extra.isNotNull(), too_long).otherwise(col(names[-1]))
    file = [F.col("_metadata.file_path").alias("file")] if places else []
    return rows.select(*[col(n) for n in names[:-1]], last.alias(names[-1]), *file)


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV file with a header; any of several tokens stands for no value.

    Without a schema the types are found in one pass over all rows: whole numbers, numbers, booleans,
    else text. A cell that a given schema does not fit is null. A quote within a cell that does not begin with one is a sign like
    others (``16" disk``). Files of a folder may have their columns in different orders. Set ``multi_line`` when quoted cells
    hold line breaks; such files cannot be split between tasks.
    """
    raw = _cells(spark, path, multi_line)
    text = raw.select(*[F.when(~col(n).isin(list(null_tokens)), col(n)).alias(n) for n in raw.columns])
    if schema is not None:
        fields = spark.createDataFrame([], schema).schema.fields
        return text.select(*[F.trim(col(f.name)).try_cast(f.dataType).alias(f.name) for f in fields])
    types = _inferred(text)
    return text.select(*[_as(types[n], col(n)).alias(n) for n in text.columns])


def scan_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """One JSON object per line; a line that is none is an error. Splits between tasks."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def _is_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull()


def _by_line(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether every line is JSON by itself. Lines of which only some are, from the first on, are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if not lines.where(~_is_json(F.col("value"))).take(1):
        return True
    # In a document that spans lines the first line of a file is a beginning and no more.
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    firsts = placed.groupBy("file").agg(F.min_by("value", "at").alias("first"))
    if firsts.where(_is_json(F.col("first"))).take(1):
        raise ValueError(f"{path} starts as JSON lines, but some lines are not JSON")
    return False


def scan_json(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, sep: str = "_") -> DataFrame:
    """A JSON document (an object or an array of objects), nested objects flattened; else JSON lines.

    A document that spans lines is read whole by one task per file, as its format demands; files with
    a record or an array on each line are read line by line. Finding out which it is takes a pass over
    the file; :func:`scan_jsonl` does without.
    """
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", not _by_line(spark, path))
    return _flat_objects((reader.schema(schema) if schema else reader).json(path), sep)


def _flat_objects(df: DataFrame, sep: str) -> DataFrame:
    """Objects flattened; lists stay lists."""
    objects = [f.name for f in df.schema.fields if f.dataType.typeName() == "struct"]
    while objects:
        df = df.select(
            *[
                c
                for f in df.schema.fields
                for c in (
                    [col(f.name).getField(g).alias(f"{f.name}{sep}{g}") for g in f.dataType.names]
                    if f.name in objects
                    else [col(f.name)]
                )
            ]
        )
        objects = [f.name for f in df.schema.fields if f.dataType.typeName() == "struct"]
    return df


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """A file by its extension: ``csv``, ``json`` (a document or lines) or ``jsonl``."""
    readers = {"csv": scan_csv, "json": scan_json, "jsonl": scan_jsonl}
    extension = path.lower().rsplit(".", 1)[-1]
    if extension not in readers:
        raise ValueError(f"no reader for {extension!r} files; there are {', '.join(readers)}")
    return readers[extension](spark, path)


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``name, path, size, modified`` of the files in a folder; their content is not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return listed.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )



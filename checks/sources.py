"""Reading and writing queries. Files and tables are made from the given tables in the shared scratch folder."""

import uuid
from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from checks.registry import COLUMNS, GAPPY, each, gappy_orders, query, table
from checks.rules import EXPRESSION_RULES, result_sql
from plumbline.operators import drift, measures, rules
from plumbline.operators.columns import stack
from plumbline.plans import source_report
from plumbline.session import scratch_path
from plumbline.sources import files, history, reports, rulesets, tables


def _as_csv(df, spark, name):
    path = scratch_path(spark, name)
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


@query(
    "scan_csv",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
    'said "' || o_orderstatus || '", twice' AS remark FROM {GAPPY}""",
)
def scan_csv(spark, sf_dir):
    """Gaps are written as several of the tokens that stand for no value."""
    orders = gappy_orders(spark, sf_dir)
    status = F.col("o_orderstatus")
    written = orders.select(
        "o_orderkey",
        F.coalesce(F.col("o_custkey").cast("string"), F.lit("N/A")).alias("o_custkey"),
        F.coalesce(status, F.lit("NULL")).alias("o_orderstatus"),
        F.coalesce(F.col("o_totalprice").cast("string"), F.lit("NaN")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
        F.concat(F.lit('said "'), status, F.lit('", twice')).alias("remark"),
    )
    return files.scan_csv(spark, _as_csv(written, spark, "orders-csv"))


@query(
    "scan_json",
    """SELECT o_orderkey, o_custkey AS customer_id, o_orderpriority AS customer_how_o_orderpriority,
    o_orderstatus AS customer_how_o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
)
def scan_json(spark, sf_dir):
    """Each line is a document of its own: an array holding one nested object."""
    path = scratch_path(spark, "orders-json")
    customer = F.struct(F.col("o_custkey").alias("id"), F.struct("o_orderpriority", "o_orderstatus").alias("how"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    row = F.to_json(F.array(F.struct("o_orderkey", customer.alias("customer"), "o_totalprice", day)))
    table(spark, sf_dir, "orders").select(row).write.text(path)
    return files.scan_json(spark, path).select(
        "o_orderkey", "customer_id", "customer_how_o_orderpriority", "customer_how_o_orderstatus", "o_totalprice", "day"
    )


@query("scan_json_document", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment AS segment_name FROM customer")
def scan_json_document(spark, sf_dir):
    """Documents that span lines: arrays of objects, the last of each an empty one."""
    path = scratch_path(spark, "customers-json")
    customers = table(spark, sf_dir, "customer")
    listed = F.to_json(F.struct("c_custkey", "c_nationkey", "c_acctbal", F.struct(F.col("c_mktsegment").alias("name")).alias("segment")))
    for k in range(8):
        rows = customers.where(F.pmod("c_custkey", F.lit(8)) == k).select(F.lit(1).alias("place"), F.concat(listed, F.lit(",")).alias("line"))
        ends = spark.createDataFrame([(0, "["), (2, "{}]")], "place int, line string")
        ends.union(rows).coalesce(1).sortWithinPartitions("place").select("line").write.mode("append").text(path)
    found = files.scan_json(spark, path).where("c_custkey IS NOT NULL")
    return found.select("c_custkey", "c_nationkey", "c_acctbal", "segment_name")


@query("scan_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_jsonl(spark, sf_dir):
    path = scratch_path(spark, "documents-jsonl")
    table(spark, sf_dir, "documents").write.json(path)
    return files.scan_jsonl(spark, path).select(*COLUMNS["documents"])


def _new_table(spark, df, name, if_exists="replace"):
    full = f"{name}_{uuid.uuid4().hex}"
    tables.write_table(df, full, if_exists, path=scratch_path(spark, full))
    return full


@query("scan_table", "SELECT * FROM supplier")
def scan_table(spark, sf_dir):
    return tables.read_table(spark, _new_table(spark, table(spark, sf_dir, "supplier"), "supplier"))


LISTED = ["region", "nation", "supplier", "part"]


@query("catalog_tables", each(LISTED, lambda t: f"""SELECT '{t}' AS "table", count(*) AS "rows" FROM {t}"""))
def catalog_tables(spark, sf_dir):
    """Tables of a schema with their row counts."""
    schema = f"plumbline_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{scratch_path(spark, schema)}'")
    for name in LISTED:
        tables.write_table(table(spark, sf_dir, name), name, "fail", schema, scratch_path(spark, name))
    counts = [
        tables.read_table(spark, name, schema).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        for name in LISTED
    ]
    return tables.list_tables(spark, schema).select("table").join(stack(counts), "table")


_ORDER_TYPES = ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]


@query(
    "table_info",
    "\nUNION ALL\n".join(
        f"""SELECT {i + 1}::INTEGER AS "position", '{c}' AS name, '{t}' AS type, true AS nullable,
        count(*) - count({c}) AS null_count FROM orders"""
        for i, (c, t) in enumerate(zip(COLUMNS["orders"], _ORDER_TYPES, strict=True))
    ),
)
def table_info(spark, sf_dir):
    """The declared columns of a table, and whether the nulls they allow occur."""
    orders = tables.read_table(spark, _new_table(spark, table(spark, sf_dir, "orders"), "orders"))
    nulls = measures.null_profile(orders).select(F.col("column").alias("name"), "null_count")
    return tables.table_info(orders).join(F.broadcast(nulls), "name")


@query(
    "scan_csv_folder",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey || '" pipe, ' || o_orderpriority ELSE o_orderkey || '" pipe' END AS size,
    CASE WHEN o_orderkey % 3 = 0 THEN 'a "b", c' ELSE 'MacBook  16"' END AS item FROM {GAPPY}""",
)
def scan_csv_folder(spark, sf_dir):
    """Files of two column orders, with inch signs in cells without quotes and commas in cells with them."""
    path = scratch_path(spark, "folder")
    orders = gappy_orders(spark, sf_dir).selectExpr(
        "*",
        """CASE WHEN o_orderkey % 5 = 0 THEN concat('"', o_orderkey, '"" pipe, ', o_orderpriority, '"') ELSE concat(o_orderkey, '" pipe') END AS size""",
        """CASE WHEN o_orderkey % 3 = 0 THEN '"a ""b"", c"' ELSE 'MacBook  16"' END AS item""",
    )
    columns = ["o_orderkey", "item", "o_custkey", "size", "o_orderstatus", "o_totalprice"]
    for k in range(8):
        order = columns if k % 2 else columns[::-1]
        rows = orders.where(F.pmod("o_orderkey", F.lit(8)) == k)
        line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
        header = spark.range(1).select(F.lit(0).alias("place"), F.lit(",".join(order)).alias("line"))
        lines = header.union(rows.select(F.lit(1), line)).coalesce(1).sortWithinPartitions("place")
        lines.select("line").write.mode("append").text(path)
    return files.scan_csv(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "size", "item")


@query("ingest_table", "SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part UNION ALL SELECT * FROM part")
def ingest_table(spark, sf_dir):
    """Replace, then append the same file."""
    csv, name = _as_csv(table(spark, sf_dir, "part"), spark, "part-csv"), f"part_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    for if_exists in ("replace", "append"):
        tables.ingest_csv(spark, csv, name, if_exists, path=path)
    return tables.read_table(spark, name)


@query(
    "ingest_with_index",
    """SELECT count(*) AS "rows", 0::BIGINT AS "first", count(*) - 1 AS "last", count(*) AS numbers, sum(p_partkey)::BIGINT AS keys, TRUE AS in_order FROM part""",
)
def ingest_with_index(spark, sf_dir):
    """Rows numbered from 0 without gaps, in file order: the part keys of a file ascend."""
    csv, name = _as_csv(table(spark, sf_dir, "part").coalesce(1).orderBy("p_partkey"), spark, "part-csv"), f"part_{uuid.uuid4().hex}"
    tables.ingest_csv(spark, csv, name, path=scratch_path(spark, name), index=True)
    rows = tables.read_table(spark, name)
    ascends = F.count_if(F.col("p_partkey") < F.col("index")) == 0
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.min("index").alias("first"), F.max("index").alias("last"), F.count_distinct("index").alias("numbers"), F.sum("p_partkey").alias("keys"), ascends.alias("in_order")
    )


@query(
    "analyze_file",
    each(
        COLUMNS["orders"],
        lambda c: f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count,
        (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::BIGINT AS unique_count,
        count(DISTINCT {c}) AS different_values, count({c}) AS counted, TRUE AS rule_holds FROM {GAPPY}""",
    ),
)
def analyze_file(spark, sf_dir):
    """The whole report of a CSV file: its metrics, and what its value counts and rules say of each column."""
    path = scratch_path(spark, "report") + ".csv"
    gappy_orders(spark, sf_dir).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.option("header", True).csv(path)
    report = source_report.analyze_file(spark, path, [{"expectation_type": rules.NOT_NULL, "column": "o_orderkey"}])
    counts = report["value_counts"].groupBy("column").agg(F.count(F.lit(1)).alias("different_values"), F.sum("count").alias("counted"))
    holds = report["rules"].agg(F.bool_and("success").alias("holds")).scalar()
    metrics = report["metrics"].select("column", "total_rows", "null_count", "unique_count")
    return metrics.join(F.broadcast(counts), "column").withColumn("rule_holds", holds)


@query(
    "write_report",
    each(
        COLUMNS["orders"],
        lambda c: f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percentage FROM {GAPPY}""",
    ),
)
def write_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    reports.write_report(measures.null_profile(gappy_orders(spark, sf_dir)), path)
    schema = "column string, total_rows bigint, null_count bigint, null_percentage double"
    return reports.read_report(spark, path, schema)


_SUMMARY = """SELECT '[{"rows":' || count(*) || ',"columns":6}]' FROM orders"""


@query(
    "profile_store",
    f"""SELECT 'orders' AS dataset_name, epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT AS at, ({_SUMMARY}) AS summary,
    (SELECT '[' || string_agg('{{"column":"' || c || '","total_rows":' || n || ',"null_count":' || m || '}}', ',' ORDER BY c) || ']'
     FROM ({each(COLUMNS["orders"], lambda c: f"SELECT '{c}' AS c, count(*) AS n, count(*) - count({c}) AS m FROM {GAPPY}")}))
    AS column_profiles""",
)
def profile_store(spark, sf_dir):
    """Two profiles are kept; the later one is found again."""
    path, orders = scratch_path(spark, "profiles"), gappy_orders(spark, sf_dir)
    summary = measures.table_shape(orders).select("rows", "columns")
    profile = measures.null_profile(orders).select("column", "total_rows", "null_count")
    older = measures.null_profile(table(spark, sf_dir, "customer")).select("column", "total_rows", "null_count")
    for month, rows in ((2, profile), (1, older)):
        history.store_profile(summary, rows, path, "orders", datetime(2024, month, 1, tzinfo=timezone.utc))
    history.store_profile(summary, profile, path, "others", datetime(2024, 3, 1, tzinfo=timezone.utc))
    latest = history.latest_profile(spark, path, "orders")
    return latest.select("dataset_name", F.unix_seconds("timestamp").alias("at"), "summary", "column_profiles")


_HALVES = [f"(SELECT * FROM events WHERE ts {op} TIMESTAMP '2024-01-16')" for op in ("<", ">=")]


@query(
    "anomaly_store",
    f"""SELECT 'events' AS dataset_name, '2024-01-16' AS comparison_date, '[{{"previous_rows":' || p || ',"current_rows":' || c
    || ',"row_difference":' || (c - p) || '}}]' AS summary, '[{{"column":"ts","values":' || c || '}}]' AS new_values,
    '[{{"column":"ts","values":' || p || '}}]' AS missing_values, p + c AS "values" FROM
    (SELECT (SELECT count(DISTINCT ts) FROM {_HALVES[0]}) AS p, (SELECT count(DISTINCT ts) FROM {_HALVES[1]}) AS c)""",
)
def anomaly_store(spark, sf_dir):
    """A comparison is kept and found again, with the values that came and went."""
    path, events = scratch_path(spark, "anomalies"), table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    before, now = events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)
    summary = drift.drift_summary(before, now).select("previous_rows", "current_rows", "row_difference")
    categories = drift.drift_categories(before, now, ["event_type", "ts"])
    day = date(2024, 1, 16)
    report_id = history.store_anomalies(summary, drift.drift_numeric(before, now), categories, path, "events", day)
    latest = history.latest_anomalies(spark, path, "events")
    kept = history.anomaly_values(spark, path, "events", report_id).agg(F.count(F.lit(1)).alias("values")).scalar()
    return latest.select(
        "dataset_name",
        F.col("comparison_date").cast("string").alias("comparison_date"),
        "summary",
        "new_values",
        "missing_values",
        kept.alias("values"),
    )


@query(
    "latest_per_key",
    """SELECT * FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_per_key(spark, sf_dir):
    return history.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])


_PART_RULES = "\nUNION ALL\n".join(
    result_sql("part", f"r{i + 1}", rule["expectation_type"], column, "true", holds)
    for i, (rule, column, holds) in enumerate(
        zip(
            EXPRESSION_RULES,
            ["p_partkey", "p_size", "p_retailprice", "p_retailprice"],
            ["true", "p_size BETWEEN 1 AND 50", *[f"round(p_retailprice, 2) = round(900 + {k} / 10, 2)" for k in ("p_partkey", "(p_partkey % 1000)")]],
            strict=True,
        )
    )
)


@query("rules_roundtrip", _PART_RULES)
def rules_roundtrip(spark, sf_dir):
    """Rules saved as a file and loaded again give the same results."""
    path = scratch_path(spark, "rules")
    rulesets.save_rules(spark, EXPRESSION_RULES, path)
    return rules.validate(table(spark, sf_dir, "part"), rulesets.load_rules(spark, path))


@query(
    "rules_list",
    f"""SELECT name, description, evaluated, successful FROM (VALUES ('prices', 'what a part costs', 1), ('sizes', NULL, 2))
    v(name, description, k) JOIN (SELECT 1 AS k, count(*) AS evaluated, count(*) FILTER (success) AS successful
      FROM ({_PART_RULES}) UNION ALL SELECT 2, count(*), count(*) FILTER (success) FROM ({_PART_RULES}) WHERE rule_id = 'r2')
    USING (k)""",
)
def rules_list(spark, sf_dir):
    """The stored rule sets, each with how many of its rules the parts pass."""
    path, part = scratch_path(spark, "rule-sets"), table(spark, sf_dir, "part")
    ids = [
        rulesets.store_rules(spark, EXPRESSION_RULES, path, "prices", "what a part costs"),
        rulesets.store_rules(spark, EXPRESSION_RULES[1:2], path, "sizes"),
    ]
    results = [
        rules.suite_summary(rules.validate(part, rulesets.stored_rules(spark, path, i))).withColumn("id", F.lit(i)) for i in ids
    ]
    listed = rulesets.list_rule_sets(spark, path).select("id", "name", "description")
    return listed.join(F.broadcast(stack(results)), "id").select("name", "description", "evaluated", "successful")

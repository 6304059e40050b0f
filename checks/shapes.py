"""Type, parsing, nesting and naming queries."""

from pyspark.sql import functions as F

from checks.registry import COLUMNS, derived, derived_sql, each, query, table
from plumbline.functions import dates, numbers
from plumbline.operators import column_types, expressions, nested
from plumbline.operators.columns import stack


@query(
    "flatten_struct",
    "SELECT event_id, user_id AS e_user_id, event_type AS e_what_event_type, value AS e_what_value FROM events",
)
def flatten_struct(spark, sf_dir):
    what = F.struct("event_type", "value").alias("what")
    return nested.flatten(table(spark, sf_dir, "events").select("event_id", F.struct("user_id", what).alias("e")))


# Every tenth props text is a plain word instead of an object.
MIXED_JSON = [
    "event_id",
    "CASE WHEN event_type = 'signup' AND value < 20 THEN 'plain' ELSE props END AS props",
]


@query(
    "flatten_json_text",
    f"""SELECT event_id, CASE WHEN props = 'plain' THEN props END AS props_value,
    CASE WHEN props <> 'plain' THEN CAST(json_extract(CASE WHEN props = 'plain' THEN '{{}}' ELSE props END, '$.k') AS BIGINT) END AS props_k
    FROM {derived_sql("events", MIXED_JSON)}""",
)
def flatten_json_text(spark, sf_dir):
    return nested.flatten_json_text(derived(spark, sf_dir, "events", MIXED_JSON), "props")


@query(
    "flatten_array_struct",
    """SELECT l_orderkey, l_linenumber, l_partkey || ',' || l_suppkey AS parts_key, l_returnflag || ',' || l_linestatus AS parts_flag
    FROM lineitem""",
)
def flatten_array_struct(spark, sf_dir):
    pair = F.array(
        F.struct(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("flag")),
        F.struct(F.col("l_suppkey").alias("key"), F.col("l_linestatus").alias("flag")),
    )
    flat = nested.flatten(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pair.alias("parts")))
    return flat.withColumns(
        {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("parts_key", "parts_flag")}
    )


@query(
    "flatten_array",
    """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS embedding_length,
    round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS total FROM embeddings""",
)
def flatten_array(spark, sf_dir):
    flat = nested.flatten(table(spark, sf_dir, "embeddings"))
    total = F.aggregate("embedding_items", F.lit(0.0), lambda s, x: s + x)
    return flat.withColumn("total", F.round(total, 6) + F.lit(0.0)).drop("embedding_items")


@query("decode_bytes", "SELECT * REPLACE (decode(encode(text)) AS text, decode(encode(source)) AS source) FROM documents")
def decode_bytes(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return nested.decode_bytes(documents.withColumns({c: F.col(c).cast("binary") for c in ("text", "source")}))


_MIDNIGHT = "CASE WHEN bool_and(date_trunc('day', {c}) = {c}) THEN 'date' ELSE 'datetime' END"


@query(
    "date_or_datetime",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", {_MIDNIGHT.format(c=c)} AS kind FROM {t}"""
        for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
    ),
)
def date_or_datetime(spark, sf_dir):
    tables = [table(spark, sf_dir, t) for t in ("orders", "lineitem", "events")]
    return stack([column_types.date_or_datetime(df) for df in tables])


_BUCKETS = {
    "orders": ["numeric", "numeric", "string", "numeric", _MIDNIGHT.format(c="o_orderdate"), "string"],
    "events": ["numeric", _MIDNIGHT.format(c="ts"), "numeric", "string", "numeric", "string"],
}


@query(
    "schema_buckets",
    "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", {f"{b} AS bucket FROM {t}" if b.startswith("CASE") else f"'{b}' AS bucket"}"""
        for t in _BUCKETS
        for c, b in zip(COLUMNS[t], _BUCKETS[t], strict=True)
    )
    + """ UNION ALL SELECT 'embeddings', unnest(['vec_id', 'embedding', 'label', 'box']), unnest(['numeric', 'array', 'numeric', 'nested'])""",
)
def schema_buckets(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings").withColumn("box", F.struct("label"))
    frames = {"orders": table(spark, sf_dir, "orders"), "events": table(spark, sf_dir, "events"), "embeddings": embeddings}
    return stack(
        [column_types.schema_buckets(df).select(F.lit(t).alias("table"), "column", "bucket") for t, df in frames.items()]
    )


ADVISED = {
    "l_orderkey": "bigint",
    "l_below": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_gaps": "double",
}
_ADVISED = [
    *[c for c in ADVISED if c not in ("l_below", "l_gaps")],
    "l_suppkey - 200 AS l_below",
    "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS l_gaps",
    "l_returnflag",
    "concat(l_returnflag, '-', l_orderkey, '-', l_partkey) AS l_label",
]
_ADVISED_SQL = derived_sql("lineitem", _ADVISED)
_HOLDS = """CASE advice WHEN 'uint8' THEN 'smallint' WHEN 'uint16' THEN 'int' WHEN 'uint32' THEN 'bigint'
  WHEN 'uint64' THEN 'decimal(20,0)' WHEN 'int8' THEN 'tinyint' WHEN 'int16' THEN 'smallint' WHEN 'int32' THEN 'int'
  WHEN 'int64' THEN 'bigint' WHEN 'float32' THEN 'float' WHEN 'category' THEN 'string' ELSE type END"""


def _advice(c):
    whole = f"bool_and({c} = round({c}, 0))"
    return f"""SELECT '{c}' AS "column", '{ADVISED[c]}' AS type, CASE WHEN count({c}) < count(*) THEN '{ADVISED[c]}'
    WHEN {whole} AND min({c}) >= 0 THEN CASE WHEN max({c}) <= 255 THEN 'uint8' WHEN max({c}) <= 65535 THEN 'uint16'
      WHEN max({c}) <= 4294967295 THEN 'uint32' ELSE 'uint64' END
    WHEN {whole} THEN CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'int8'
      WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'int16'
      WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int32' ELSE 'int64' END
    WHEN max(abs(CAST({c} AS DOUBLE) - CAST(CAST({c} AS FLOAT) AS DOUBLE))) < 1e-6 THEN 'float32'
    ELSE '{ADVISED[c]}' END AS advice FROM {_ADVISED_SQL}"""


@query(
    "type_advice",
    f"""SELECT *, {_HOLDS} AS spark_type FROM (
    {each(list(ADVISED), _advice)} UNION ALL
    {each(["l_returnflag", "l_label"], lambda c: f'''SELECT '{c}', 'string',
      CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) < 0.5 THEN 'category' ELSE 'string' END FROM {_ADVISED_SQL}''')})""",
)
def type_advice(spark, sf_dir):
    return column_types.type_advice(derived(spark, sf_dir, "lineitem", _ADVISED))


# A table in which everything but the key and one date is text.
AS_TEXT = [
    "o_orderkey",
    "CAST(o_custkey AS VARCHAR(20)) AS whole",
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(20)) AS price",
    "substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS day",
    "CASE WHEN o_orderstatus = 'P' THEN 'Yes' WHEN o_orderstatus = 'F' THEN 'no' END AS flag",
    "o_orderpriority",
    "concat('order ', o_orderkey) AS label",
    "CAST(NULL AS VARCHAR(9)) AS nothing",
    "o_orderdate",
]
_AS_TEXT_SQL = derived_sql("orders", AS_TEXT)


def _detected(c, base, specific, sample="CAST(NULL AS VARCHAR)"):
    return f"""SELECT '{c}' AS "column", '{base}' AS base_type, '{specific}' AS specific_type, {sample} AS sample_format,
    coalesce(round(count(DISTINCT {c})::DOUBLE / nullif(count({c}), 0), 6), 0) AS unique_ratio FROM {_AS_TEXT_SQL}"""


@query(
    "detect_types",
    "\nUNION ALL\n".join(
        [
            _detected("o_orderkey", "numeric", "integer", "CAST(min(o_orderkey) AS VARCHAR)"),
            _detected("whole", "numeric", "integer", "CAST(min(CAST(whole AS BIGINT)) AS VARCHAR)"),
            _detected("price", "numeric", "float", "printf('%.2f', min(CAST(price AS DOUBLE)))"),
            _detected("day", "datetime", "datetime", "strftime(min(CAST(day AS DATE)), '%Y-%m-%d 00:00:00')"),
            _detected("flag", "boolean", "boolean"),
            _detected("o_orderpriority", "categorical", "categorical"),
            _detected("label", "string", "string"),
            _detected("nothing", "unknown", "unknown"),
            _detected("o_orderdate", "datetime", "datetime64", "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S')"),
        ]
    ),
)
def detect_types(spark, sf_dir):
    found = column_types.detect_types(derived(spark, sf_dir, "orders", AS_TEXT))
    return found.withColumn("unique_ratio", F.round("unique_ratio", 6))


_PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(20))"
NUMBER_TEXT = [
    "l_orderkey",
    "l_linenumber",
    f"""CASE l_linenumber WHEN 1 THEN concat('$', {_PRICE}) WHEN 2 THEN concat('(', {_PRICE}, ')')
    WHEN 3 THEN concat({_PRICE}, '%') WHEN 4 THEN concat('€ ', {_PRICE}, ' ') WHEN 5 THEN concat('1,', lpad({_PRICE}, 10, '0'))
    WHEN 6 THEN concat({_PRICE}, 'd') ELSE {_PRICE} END AS amount""",
]


@query(
    "parse_decimal",
    f"""WITH t AS {derived_sql("lineitem", NUMBER_TEXT)},
    b AS (SELECT *, regexp_replace(regexp_replace(amount, '^\\((.*)\\)$', '\\1'), '[$£€¥,\\s%]', '', 'g') AS bare FROM t)
    SELECT l_orderkey, l_linenumber, amount, CASE WHEN regexp_matches(bare, '^[+-]?[0-9]+[.]?[0-9]*$') THEN
      CASE WHEN amount LIKE '(%)' THEN -1 ELSE 1 END * CAST(regexp_extract(bare, '^[+-]?[0-9]+[.]?[0-9]*$') AS DOUBLE)
      / CASE WHEN contains(amount, '%') THEN 100 ELSE 1 END END AS parsed FROM b""",
)
def parse_decimal(spark, sf_dir):
    texts = derived(spark, sf_dir, "lineitem", NUMBER_TEXT)
    return texts.withColumn("parsed", numbers.parse_number(F.col("amount")))


_Y, _M, _D = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
TIME_TEXT = [
    "o_orderkey",
    "o_orderdate",
    f"""CASE o_orderstatus WHEN 'O' THEN concat({_M}, '/', {_D}, '/', {_Y}) WHEN 'F' THEN concat({_Y}, '-', {_M}, '-', {_D}, 'T00:00:00')
    ELSE concat({_Y}, '/', {_M}, '/', {_D}) END AS written""",
]


@query("parse_datetime", "SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def parse_datetime(spark, sf_dir):
    texts = derived(spark, sf_dir, "orders", TIME_TEXT)
    # The format fits none of the texts, so it gives way to the known ones.
    return texts.select("o_orderkey", expressions.parse_datetime(texts, "written", "%d.%m.%y").alias("parsed"))


@query(
    "parse_datetime_in_format",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS parsed FROM orders""",
)
def parse_datetime_in_format(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day_first = F.date_format("o_orderdate", "dd/MM/yyyy")
    written = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(day_first)
    texts = orders.select("o_orderkey", written.alias("written"))
    return texts.select("o_orderkey", expressions.parse_datetime(texts, "written", "%d/%m/%Y").alias("parsed"))


@query("parse_excel_date", "SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS parsed FROM orders")
def parse_excel_date(spark, sf_dir):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    serial = (days + (F.col("o_orderkey") % 24) / 24).cast("string")
    texts = table(spark, sf_dir, "orders").select("o_orderkey", serial.alias("serial"))
    return texts.select("o_orderkey", expressions.parse_datetime(texts, "serial").alias("parsed"))


FLAG_TEXT = [
    "event_id",
    """CASE event_type WHEN 'click' THEN ' Yes ' WHEN 'view' THEN 'T' WHEN 'error' THEN 'no' WHEN 'signup' THEN '1' END AS word""",
]


@query(
    "parse_boolean",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE 0 END AS flag FROM events""",
)
def parse_boolean(spark, sf_dir):
    return derived(spark, sf_dir, "events", FLAG_TEXT).select("event_id", numbers.parse_flag(F.col("word")).alias("flag"))


@query("epoch_seconds", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def epoch_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.epoch_seconds(F.col("ts")).alias("seconds"))


@query(
    "expr_column",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
    l_extendedprice / nullif(l_discount, 0) AS ratio, CAST(floor(epoch(l_shipdate)) AS BIGINT) - l_orderkey % 7 AS shifted
    FROM lineitem""",
)
def expr_column(spark, sf_dir):
    wanted = {
        "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
        "ratio": "l_extendedprice / l_discount",
        "shifted": "l_shipdate - l_orderkey % 7",
    }
    lineitem = table(spark, sf_dir, "lineitem")
    added = {name: expressions.expression(lineitem, text) for name, text in wanted.items()}
    return lineitem.withColumns(added).select("l_orderkey", "l_linenumber", *wanted)


@query(
    "rename_spaces",
    """SELECT c_custkey, c_acctbal AS account_balance, c_mktsegment AS market_segment_name,
    round(c_acctbal * 2, 2) AS twice FROM customer""",
)
def rename_spaces(spark, sf_dir):
    spaced = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_acctbal AS `account balance`", "c_mktsegment AS `market segment name`"
    )
    return column_types.rename_spaces(expressions.add_expression(spaced, "twice", "account balance * 2", 2))


# Objects, arrays of objects, arrays, numbers and text in one column; the objects' "k" meets that of the arrays.
SEVERAL_JSON = [
    "event_id",
    """CASE event_id % 6 WHEN 0 THEN concat('[{"k": ', event_id, '}, {"k": null, "z": "y"}]') WHEN 1 THEN concat('{"k": ', event_id, ', "s": {"t": "', event_type, '"}}')
    WHEN 2 THEN '[]' WHEN 3 THEN event_type WHEN 4 THEN CAST(user_id AS VARCHAR(20)) ELSE NULL END AS props""",
]


@query(
    "flatten_json_mixed",
    f"""SELECT event_id, CASE WHEN event_id % 6 IN (3, 4) THEN props END AS props_value,
    CASE WHEN event_id % 6 = 1 THEN event_id END AS props_k, CASE WHEN event_id % 6 = 1 THEN event_type END AS props_s_t,
    CASE event_id % 6 WHEN 0 THEN event_id || ',null' WHEN 2 THEN '' END AS props_list_k, CASE event_id % 6 WHEN 0 THEN 'null,y' WHEN 2 THEN '' END AS props_list_z
    FROM (SELECT *, {SEVERAL_JSON[1].replace("concat('[", "concat('[")} FROM (SELECT event_id, user_id, event_type FROM events))""",
)
def flatten_json_mixed(spark, sf_dir):
    flat = nested.flatten_json_text(derived(spark, sf_dir, "events", SEVERAL_JSON), "props")
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",", "null")
    return flat.withColumns({c: shown(c) for c in ("props_list_k", "props_list_z")})


# Columns whose range does not depend on the size of the data, and keys, whose advice does: their values only.
ADVISED = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "whole"]


@query(
    "apply_advice",
    """SELECT l_linenumber::SMALLINT AS l_linenumber, l_quantity::SMALLINT AS l_quantity, l_discount::FLOAT AS l_discount, l_tax::FLOAT AS l_tax,
    l_returnflag, l_linestatus, l_shipdate, (l_linenumber * 1000 - 3000)::SMALLINT AS whole,
    l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, round(l_extendedprice, 2)::DOUBLE AS l_extendedprice FROM lineitem""",
)
def apply_advice(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").withColumn("whole", F.expr("l_linenumber * 1000D - 3000D"))
    advised = column_types.apply_advice(lineitem)
    keys = [F.col(k).cast("bigint").alias(k) for k in ("l_orderkey", "l_partkey", "l_suppkey")]
    return advised.select(*ADVISED, *keys, F.round(F.col("l_extendedprice").cast("double"), 2).alias("l_extendedprice"))


@query(
    "json_report_rows",
    """SELECT to_json({'event_id': event_id, 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END,
    'user_id': user_id, 'event_type': event_type, 'value': value, 'props': nullif(props, '{"k": 1}')})::VARCHAR AS json
    FROM events""",
)
def json_report_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("props", F.nullif("props", F.lit('{"k": 1}')))
    return column_types.json_rows(events)

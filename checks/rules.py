"""Rule validation queries."""

from checks.registry import GAPPY, derived, derived_sql, gappy_orders, query, table
from plumbline.operators import record_schema, rules
from plumbline.operators.sentences import sentence_rules
from plumbline.plans.validation import validate_table


def result_sql(source, rule_id, kind, column, applies, holds, mostly=None):
    """The result row of one row rule."""
    passes = "failed = 0" if mostly is None else f"coalesce((n - failed)::DOUBLE / nullif(n, 0) >= {mostly}, true)"
    return f"""SELECT '{rule_id}' AS rule_id, '{kind}' AS expectation_type, '{column}' AS "column",
    element_count, element_count - n AS missing_count, failed AS unexpected_count,
    failed * 100 / nullif(n, 0)::DOUBLE AS unexpected_percent, NULL::DOUBLE AS observed_value, {passes} AS success
    FROM (SELECT count(*) AS element_count, count(*) FILTER ({applies}) AS n,
      count(*) FILTER (({applies}) AND NOT coalesce(({holds}), false)) AS failed FROM {source})"""


def rule_query(name, source, sql_source, listed):
    """Register a rule query; each entry gives the rule, and how SQL says it applies to and holds for a row."""
    entries, statements = [], []
    for i, (kind, settings, applies, holds, *meta) in enumerate(listed):
        rule = {"expectation_type": kind, "kwargs": settings, "rule_id": f"r{i + 1}", "meta": meta[0] if meta else {}}
        entries.append(rule)
        column = settings.get("column", settings.get("column_A"))
        statements.append(
            result_sql(sql_source, rule["rule_id"], kind, column, applies, holds, settings.get("mostly"))
        )

    @query(name, "\nUNION ALL\n".join(statements))
    def run(spark, sf_dir):
        return rules.validate(source(spark, sf_dir), entries)

    return entries


def _given(name):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


rule_query(
    "rule_not_null",
    gappy_orders,
    GAPPY,
    [
        (rules.NOT_NULL, {"column": c}, "true", f"{c} IS NOT NULL")
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ],
)
rule_query(
    "rule_in_set",
    gappy_orders,
    GAPPY,
    [
        (
            rules.IN_SET,
            {"column": "o_orderpriority", "value_set": ["1-URGENT", "2-HIGH", "3-MEDIUM", 4]},
            "o_orderpriority IS NOT NULL",
            "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
        ),
        (rules.IN_SET, {"column": "o_custkey", "value_set": [1, 2, 3, "4"]}, "o_custkey IS NOT NULL", "o_custkey IN (1, 2, 3)"),
        (
            rules.IN_SET,
            {"column": "o_orderstatus", "value_set": ["F", "O"]},
            "o_orderstatus IS NOT NULL",
            "o_orderstatus IN ('F', 'O')",
        ),
    ],
)
rule_query(
    "rule_regex",
    _given("documents"),
    "documents",
    [
        (rules.MATCH, {"column": "lang", "regex": "^[a-z]{2}$"}, "lang IS NOT NULL", "regexp_matches(lang, '^[a-z]{2}$')"),
        (rules.MATCH, {"column": "text", "regex": "[0-9]{3}"}, "text IS NOT NULL", "regexp_matches(text, '[0-9]{3}')"),
        (
            rules.MATCH,
            {"column": "n_chars", "regex": "^[1-9][0-9]*$"},
            "n_chars IS NOT NULL",
            "regexp_matches(n_chars::VARCHAR, '^[1-9][0-9]*$')",
        ),
    ],
)
rule_query(
    "rule_not_regex",
    _given("documents"),
    "documents",
    [
        (
            rules.NOT_MATCH,
            {"column": "text", "regex": "[A-Za-z0-9._]+@[A-Za-z0-9]+"},
            "text IS NOT NULL",
            "NOT regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+')",
        ),
        (rules.NOT_MATCH, {"column": "source", "regex": "^\\s*$"}, "source IS NOT NULL", "NOT regexp_matches(source, '^\\s*$')"),
    ],
)
rule_query(
    "rule_between",
    _given("lineitem"),
    "lineitem",
    [
        (rules.BETWEEN, {"column": "l_quantity", "min_value": 1, "max_value": 45}, "l_quantity IS NOT NULL", "l_quantity BETWEEN 1 AND 45"),
        (rules.BETWEEN, {"column": "l_tax", "max_value": 0.05}, "l_tax IS NOT NULL", "l_tax <= 0.05::DOUBLE"),
        (
            rules.BETWEEN,
            {"column": "l_shipdate", "min_value": "1996-01-01", "max_value": "1999-12-31"},
            "l_shipdate IS NOT NULL",
            "l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'",
        ),
        (
            rules.BETWEEN,
            {"column": "l_returnflag", "min_value": "N", "max_value": "Z"},
            "l_returnflag IS NOT NULL",
            "l_returnflag BETWEEN 'N' AND 'Z'",
        ),
    ],
)
rule_query(
    "rule_gt_lt",
    _given("customer"),
    "customer",
    [
        (rules.GREATER, {"column": "c_acctbal", "value": 0}, "c_acctbal IS NOT NULL", "c_acctbal > 0"),
        (rules.LESS, {"column": "c_acctbal", "value": 9000.5}, "c_acctbal IS NOT NULL", "c_acctbal < 9000.5::DOUBLE"),
    ],
)

PAIRS = [
    "l_orderkey",
    "l_quantity",
    "concat('$', CAST(l_quantity AS DECIMAL(9,0)), CASE l_linenumber WHEN 3 THEN '.5' ELSE '.0' END) AS said",
    "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_shipdate END AS shipped",
    "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_shipdate END AS sent",
    "CASE WHEN l_linenumber < 4 THEN NULL ELSE l_tax END AS a",
    "CASE WHEN l_linenumber < 3 THEN NULL ELSE l_tax END AS b",
    # texts of which one in seven reads as a number
    "CASE l_linenumber WHEN 1 THEN '5' WHEN 2 THEN 'abc' WHEN 3 THEN 'q' ELSE l_returnflag END AS word",
    "CASE l_linenumber WHEN 1 THEN '5.0' WHEN 2 THEN 'xyz' WHEN 3 THEN NULL ELSE l_returnflag END AS other",
]
PAIRS_SQL = derived_sql("lineitem", PAIRS)


def _either(a, b):
    return f"{a} IS NOT NULL OR {b} IS NOT NULL"


rule_query(
    "rule_pair_equal",
    lambda spark, sf_dir: derived(spark, sf_dir, "lineitem", PAIRS),
    PAIRS_SQL,
    [
        (
            rules.PAIR_EQUAL,
            {"column_A": "l_quantity", "column_B": "said"},
            "true",
            "l_quantity = CAST(replace(said, '$', '') AS DOUBLE)",
        ),
        (rules.PAIR_EQUAL, {"column_A": "shipped", "column_B": "sent"}, _either("shipped", "sent"), "shipped = sent"),
        (rules.PAIR_EQUAL, {"column_A": "a", "column_B": "b"}, _either("a", "b"), "a = b"),
        (rules.PAIR_EQUAL, {"column_A": "shipped", "column_B": "a"}, _either("shipped", "a"), "false"),
        (rules.PAIR_EQUAL, {"column_A": "word", "column_B": "other"}, _either("word", "other"), "word = other OR (word = '5' AND other = '5.0')"),
        (rules.PAIR_EQUAL, {"column_A": "l_quantity", "column_B": "word"}, "true", "l_quantity = TRY_CAST(word AS DOUBLE)"),
    ],
)

# Sets that are frames: values of another table.
_MEMBERS = """(SELECT *, l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AS known_part,
    l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS known_supplier FROM lineitem)"""
_SAID = "(SELECT *, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS known FROM documents)"


@query(
    "rule_in_frame",
    "\nUNION ALL\n".join(
        [
            result_sql(_MEMBERS, "r1", rules.IN_SET, "l_partkey", "l_partkey IS NOT NULL", "known_part"),
            result_sql(_MEMBERS, "r2", rules.IN_SET, "l_suppkey", "l_suppkey IS NOT NULL", "known_supplier", 0.5),
            result_sql(_MEMBERS, "r3", rules.IN_SET, "l_returnflag", "l_returnflag IS NOT NULL", "false"),
            result_sql(_SAID, "r4", rules.IN_SET, "text", "text IS NOT NULL", "known"),
        ]
    ),
)
def rule_in_frame(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    documents = table(spark, sf_dir, "documents")

    def of(rule_id, column, values, **more):
        return {"expectation_type": rules.IN_SET, "rule_id": rule_id, "kwargs": {"column": column, "value_set": values, **more}}

    listed = [of("r1", "l_partkey", part), of("r2", "l_suppkey", suppliers, mostly=0.5), of("r3", "l_returnflag", part)]
    texts = rules.validate(documents, [of("r4", "text", documents.where("doc_id % 2 = 0").select("text"))])
    return rules.validate(table(spark, sf_dir, "lineitem"), listed).union(texts)


@query(
    "rule_unexpected_values",
    f"""SELECT 'r1' AS rule_id, 'o_totalprice' AS "column", CAST(o_totalprice AS VARCHAR) AS value, count(*) AS "count" FROM {GAPPY}
    WHERE o_totalprice > 400000 GROUP BY o_totalprice
    UNION ALL SELECT 'r2', 'o_orderpriority', o_orderpriority, count(*) FROM {GAPPY} WHERE o_orderpriority NOT LIKE '%M%' GROUP BY ALL
    UNION ALL SELECT 'r3', 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM {GAPPY} WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1
    UNION ALL SELECT 'r4', 'o_orderkey', CAST(o_orderkey AS VARCHAR), count(*) FROM {GAPPY} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 25) GROUP BY ALL""",
)
def rule_unexpected_values(spark, sf_dir):
    """The values that fail, with how often they do."""
    small = table(spark, sf_dir, "lineitem").where("l_quantity < 25").select("l_orderkey")
    listed = [
        {"rule_id": "r1", "expectation_type": rules.BETWEEN, "column": "o_totalprice", "max_value": 400000},
        {"rule_id": "r2", "expectation_type": rules.MATCH, "column": "o_orderpriority", "regex": "M"},
        {"rule_id": "r3", "expectation_type": rules.UNIQUE, "column": "o_custkey"},
        {"rule_id": "r4", "expectation_type": rules.IN_SET, "column": "o_orderkey", "value_set": small},
    ]
    return rules.unexpected_values(gappy_orders(spark, sf_dir), listed)


@query(
    "rule_dates_in_a_format",
    result_sql("orders", "r1", rules.PAIR_EQUAL, "written", "true", "o_orderdate < TIMESTAMP '1995-01-01'"),
)
def rule_dates_in_a_format(spark, sf_dir):
    """Days before months, as the rule says; from 1995 on the other column is a day off."""
    orders = table(spark, sf_dir, "orders")
    shown = orders.selectExpr("*", "date_format(o_orderdate, 'dd/MM/yyyy') AS written", "date_format(o_orderdate + CASE WHEN o_orderdate < TIMESTAMP_NTZ '1995-01-01' THEN INTERVAL '0' DAY ELSE INTERVAL '1' DAY END, 'dd/MM/yyyy') AS meant")
    rule = {"rule_id": "r1", "expectation_type": rules.PAIR_EQUAL, "kwargs": {"column_A": "written", "column_B": "meant"}, "meta": {"date_format": "%d/%m/%Y"}}
    return rules.validate(shown, [rule])

EXPRESSION_RULES = rule_query(
    "rule_expr_equal",
    _given("part"),
    "part",
    [
        (rules.NOT_NULL, {"column": "p_partkey"}, "true", "p_partkey IS NOT NULL"),
        (rules.BETWEEN, {"column": "p_size", "min_value": 1, "max_value": 50}, "p_size IS NOT NULL", "p_size BETWEEN 1 AND 50"),
        (
            rules.PAIR_EQUAL,
            {"column_A": "p_retailprice", "column_B": "900 + p_partkey / 10"},
            "true",
            "round(p_retailprice, 2) = round(900 + p_partkey / 10, 2)",
            {"decimal_places": 2},
        ),
        (
            rules.PAIR_EQUAL,
            {"column_A": "p_retailprice", "value": {"$eval": "900 + (p_partkey % 1000) / 10"}},
            "true",
            "round(p_retailprice, 2) = round(900 + (p_partkey % 1000) / 10, 2)",
            {"decimal_places": 2},
        ),
    ],
)
rule_query(
    "rule_date_parseable",
    lambda spark, sf_dir: derived(spark, sf_dir, "orders", WRITTEN),
    derived_sql("orders", WRITTEN := [
        "o_orderdate",
        "CASE o_orderstatus WHEN 'P' THEN 'soon' WHEN 'F' THEN NULL ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS day",
    ]),
    [
        (rules.DATE_PARSEABLE, {"column": "day"}, "day IS NOT NULL", "try_cast(day AS DATE) IS NOT NULL"),
        (rules.DATE_PARSEABLE, {"column": "o_orderdate"}, "true", "true"),
    ],
)
MOSTLY = [
    (rules.NOT_NULL, {"column": "o_custkey", "mostly": 0.9}, "true", "o_custkey IS NOT NULL"),
    (rules.NOT_NULL, {"column": "o_totalprice", "mostly": 0.9}, "true", "o_totalprice IS NOT NULL"),
    (
        rules.BETWEEN,
        {"column": "o_totalprice", "min_value": 150000, "max_value": 1000000, "mostly": 0.85},
        "o_totalprice IS NOT NULL",
        "o_totalprice BETWEEN 150000 AND 1000000",
    ),
    (
        rules.MATCH,
        {"column": "o_orderpriority", "regex": "^[123]", "mostly": 0.7},
        "o_orderpriority IS NOT NULL",
        "regexp_matches(o_orderpriority, '^[123]')",
    ),
]
MOSTLY_RULES = rule_query("rule_mostly", gappy_orders, GAPPY, MOSTLY)
rule_query(
    "rule_not_empty",
    lambda spark, sf_dir: derived(spark, sf_dir, "documents", BLANKS),
    derived_sql("documents", BLANKS := ["CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN '  ' ELSE text END AS text"]),
    [
        (rules.NOT_NULL, {"column": "text"}, "true", "text IS NOT NULL"),
        (rules.NOT_MATCH, {"column": "text", "regex": "^\\s*$"}, "text IS NOT NULL", "NOT regexp_matches(text, '^\\s*$')"),
    ],
)


def _unique_sql(rule_id, column, source):
    return f"""SELECT '{rule_id}' AS rule_id, '{rules.UNIQUE}' AS expectation_type, '{column}' AS "column",
    sum(n)::BIGINT AS element_count, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS missing_count,
    coalesce(sum(n) FILTER (v IS NOT NULL AND n > 1), 0)::BIGINT AS unexpected_count,
    coalesce(sum(n) FILTER (v IS NOT NULL AND n > 1), 0) * 100 / (sum(n) FILTER (v IS NOT NULL))::DOUBLE AS unexpected_percent,
    NULL::DOUBLE AS observed_value, coalesce(sum(n) FILTER (v IS NOT NULL AND n > 1), 0) = 0 AS success
    FROM (SELECT {column} AS v, count(*) AS n FROM {source} GROUP BY ALL)"""


@query(
    "rule_unique",
    "\nUNION ALL\n".join(
        _unique_sql(f"rule_{i + 1}", c, GAPPY) for i, c in enumerate(("o_orderkey", "o_custkey", "o_totalprice"))
    ),
)
def rule_unique(spark, sf_dir):
    # the flat layout, without ids
    flat = [{"expectation_type": rules.UNIQUE, "column": c} for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    return rules.validate(gappy_orders(spark, sf_dir), {"expectations": flat})


def _whole_sql(rule_id, kind, column, observed, missing, holds, source):
    named = f"'{column}'" if column else "NULL::VARCHAR"
    return f"""SELECT '{rule_id}' AS rule_id, '{kind}' AS expectation_type, {named} AS "column", count(*) AS element_count,
    {missing} AS missing_count, NULL::BIGINT AS unexpected_count, NULL::DOUBLE AS unexpected_percent,
    round({observed}, 4) AS observed_value, {holds} AS success FROM {source}"""


def _rounded(results):
    return results.selectExpr("* EXCEPT (observed_value)", "round(observed_value, 4) AS observed_value")


@query(
    "rule_row_count",
    "\nUNION ALL\n".join(
        _whole_sql(f"rule_{i}", rules.ROW_COUNT, None, "count(*)::DOUBLE", "0::BIGINT", holds, "orders")
        for i, holds in ((1, "count(*) BETWEEN 1 AND 1000000"), (2, "count(*) <= 10"), (3, "count(*) >= 10"))
    ),
)
def rule_row_count(spark, sf_dir):
    bounds = [{"min_value": 1, "max_value": 1000000}, {"max_value": 10}, {"min_value": 10}]
    listed = [{"expectation_type": rules.ROW_COUNT, "kwargs": b} for b in bounds]
    return _rounded(rules.validate(table(spark, sf_dir, "orders"), listed))


@query(
    "rule_mean_between",
    "\nUNION ALL\n".join(
        _whole_sql(f"rule_{i}", rules.MEAN_BETWEEN, c, f"avg({c})", f"count(*) - count({c})", holds, GAPPY)
        for i, c, holds in (
            (1, "o_totalprice", "avg(o_totalprice) BETWEEN 1000 AND 290000"),
            (2, "o_custkey", "avg(o_custkey) <= 10"),
        )
    ),
)
def rule_mean_between(spark, sf_dir):
    listed = [
        {"expectation_type": rules.MEAN_BETWEEN, "column": "o_totalprice", "min_value": 1000, "max_value": 290000},
        {"expectation_type": rules.MEAN_BETWEEN, "column": "o_custkey", "max_value": 10},
    ]
    return _rounded(rules.validate(gappy_orders(spark, sf_dir), {"expectations": listed}))


_MOSTLY_SQL = "\nUNION ALL\n".join(
    result_sql(GAPPY, f"r{i + 1}", kind, kw["column"], applies, holds, kw["mostly"])
    for i, (kind, kw, applies, holds) in enumerate(MOSTLY)
)


@query(
    "rule_suite_summary",
    f"""SELECT count(*) AS evaluated, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS unsuccessful,
    round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 6) AS success_percent, bool_and(success) AS success
    FROM ({_MOSTLY_SQL})""",
)
def rule_suite_summary(spark, sf_dir):
    summary = rules.suite_summary(rules.validate(gappy_orders(spark, sf_dir), MOSTLY_RULES))
    return summary.selectExpr("* EXCEPT (success_percent)", "round(success_percent, 6) AS success_percent")


SENTENCES = [
    "The 'O_Custkey' column should not be null",
    "The 'o_totalprice' column should be between 100000 and 300000",
    "the 'o_orderstatus' column should not be empty",
    "The 'o_orderkey' column should be greater than 100",
    "The 'o_orderkey' column should be less than 100",
    "this says nothing",
]


@query(
    "rule_sentences",
    "\nUNION ALL\n".join(
        [
            result_sql(GAPPY, "sentence_1", rules.NOT_NULL, "o_custkey", "true", "o_custkey IS NOT NULL"),
            result_sql(GAPPY, "sentence_2", rules.BETWEEN, "o_totalprice", "o_totalprice IS NOT NULL", "o_totalprice BETWEEN 100000 AND 300000"),
            result_sql(GAPPY, "sentence_3", rules.NOT_NULL, "o_orderstatus", "true", "o_orderstatus IS NOT NULL"),
            result_sql(
                GAPPY, "sentence_3_blank", rules.NOT_MATCH, "o_orderstatus", "o_orderstatus IS NOT NULL",
                "NOT regexp_matches(o_orderstatus, '^\\s*$')",
            ),
            result_sql(GAPPY, "sentence_4", rules.GREATER, "o_orderkey", "o_orderkey IS NOT NULL", "o_orderkey > 100"),
            result_sql(GAPPY, "sentence_5", rules.LESS, "o_orderkey", "o_orderkey IS NOT NULL", "o_orderkey < 100"),
        ]
    ),
)
def rule_sentences(spark, sf_dir):
    return rules.validate(gappy_orders(spark, sf_dir), sentence_rules(SENTENCES))


RECORD = {
    "properties": {
        "c_custkey": {"type": "integer", "minimum": 1},
        "c_name": {"type": "string", "minLength": 1, "maxLength": 17},
        "c_acctbal": {"type": "number", "minimum": 0, "maximum": 9000},
        "email": {"type": "string", "format": "email"},
        "joined": {"type": "string", "format": "date-time"},
    },
    "required": ["c_custkey", "c_name", "email", "phone"],
}
RECORDS = [
    "c_custkey",
    "c_name",
    "c_acctbal",
    "CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_nationkey < 5 THEN c_name ELSE concat('c', c_custkey, '@example.com') END AS email",
    "CASE WHEN c_nationkey < 5 THEN 'never' ELSE '2024-01-02T03:04:05' END AS joined",
]
_RECORDS_SQL = derived_sql("customer", RECORDS)
_EMAIL = f"regexp_matches(email, '{record_schema.EMAIL}')"


@query(
    "schema_check",
    "\nUNION ALL\n".join(
        result_sql(_RECORDS_SQL, f"{column}.{demand}", demand, column, applies, holds)
        for column, demand, applies, holds in [
            ("c_custkey", "required", "true", "c_custkey IS NOT NULL"),
            ("c_name", "required", "true", "c_name IS NOT NULL"),
            ("email", "required", "true", "email IS NOT NULL"),
            ("phone", "required", "true", "false"),
            ("c_custkey", "type", "true", "true"),
            ("c_custkey", "minimum", "true", "c_custkey >= 1"),
            ("c_name", "type", "true", "true"),
            ("c_name", "minLength", "true", "length(c_name) >= 1"),
            ("c_name", "maxLength", "true", "length(c_name) <= 17"),
            ("c_acctbal", "type", "true", "true"),
            ("c_acctbal", "minimum", "true", "c_acctbal >= 0"),
            ("c_acctbal", "maximum", "true", "c_acctbal <= 9000"),
            ("email", "type", "email IS NOT NULL", "true"),
            ("email", "format", "email IS NOT NULL", _EMAIL),
            ("joined", "type", "true", "true"),
            ("joined", "format", "true", "try_cast(joined AS TIMESTAMP) IS NOT NULL"),
        ]
    ),
)
def schema_check(spark, sf_dir):
    return record_schema.schema_check(derived(spark, sf_dir, "customer", RECORDS), RECORD)


@query(
    "failing_rows",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'big' END,
      CASE WHEN round(p_retailprice, 2) <> round(900 + p_partkey / 10, 2) THEN 'price' END,
      CASE WHEN p_type <> 'SMALL' THEN 'type' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM part
    WHERE p_size > 40 OR round(p_retailprice, 2) <> round(900 + p_partkey / 10, 2) OR p_type <> 'SMALL'""",
)
def failing_rows(spark, sf_dir):
    listed = [
        {"rule_id": "big", "expectation_type": rules.BETWEEN, "kwargs": {"column": "p_size", "max_value": 40}},
        {**EXPRESSION_RULES[2], "rule_id": "price"},
        {"rule_id": "type", "expectation_type": rules.IN_SET, "kwargs": {"column": "p_type", "value_set": ["SMALL"]}},
    ]
    found = rules.failing_rows(table(spark, sf_dir, "part"), listed)
    return found.selectExpr("p_partkey", "array_join(failed_rules, ',') AS failed_rules")


SPACED = ["c_custkey", "c_acctbal AS `account balance`", "c_acctbal * 2 AS `twice it`"]


@query(
    "validate_table",
    "\nUNION ALL\n".join(
        [
            result_sql("customer", "positive", rules.GREATER, "account_balance", "true", "c_acctbal > 0"),
            result_sql("customer", "double", rules.PAIR_EQUAL, "twice_it", "true", "true"),
        ]
    ),
)
def validate_table_query(spark, sf_dir):
    listed = [
        {"rule_id": "positive", "expectation_type": rules.GREATER, "kwargs": {"column": "account balance", "value": 0}},
        {
            "rule_id": "double",
            "expectation_type": rules.PAIR_EQUAL,
            "kwargs": {"column_A": "twice it", "column_B": "account balance * 2"},
        },
    ]
    return validate_table(derived(spark, sf_dir, "customer", SPACED), listed)

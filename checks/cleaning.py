"""Filling, scaling and cleaning queries."""

from pyspark.sql import functions as F

from checks.registry import GAPPY, derived, derived_sql, gappy_orders, query, rounded, table
from plumbline.operators import filling
from plumbline.plans.preparation import preprocess

_MEDIANS = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in ("o_custkey", "o_totalprice"))


@query(
    "impute_median",
    f"""SELECT o_orderkey, coalesce(CAST(g.o_custkey AS DOUBLE), m.o_custkey) AS o_custkey, o_orderstatus,
    coalesce(g.o_totalprice, m.o_totalprice) AS o_totalprice, o_orderdate, o_orderpriority
    FROM {GAPPY} g, (SELECT {_MEDIANS} FROM {GAPPY}) m""",
)
def impute_median(spark, sf_dir):
    return filling.impute_median(gappy_orders(spark, sf_dir))


def _mode(c, source):
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


WITHOUT_VALUES = ["o_orderkey", "NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority", "CAST(NULL AS VARCHAR(9)) AS nothing"]
WITHOUT_VALUES_SQL = derived_sql("orders", WITHOUT_VALUES)


@query(
    "impute_mode",
    f"""SELECT o_orderkey, coalesce(o_orderpriority, {_mode("o_orderpriority", WITHOUT_VALUES_SQL)}, 'Unknown') AS o_orderpriority,
    'Unknown' AS nothing FROM {WITHOUT_VALUES_SQL}""",
)
def impute_mode(spark, sf_dir):
    return filling.impute_mode(derived(spark, sf_dir, "orders", WITHOUT_VALUES))


@query(
    "impute_mean",
    f"""SELECT o_orderkey, round(coalesce(CAST(g.o_custkey AS DOUBLE), m.o_custkey), 4) AS o_custkey, o_orderstatus,
    round(coalesce(g.o_totalprice, m.o_totalprice), 4) AS o_totalprice, o_orderdate, o_orderpriority
    FROM {GAPPY} g, (SELECT avg(o_custkey) AS o_custkey, avg(o_totalprice) AS o_totalprice FROM {GAPPY}) m""",
)
def impute_mean(spark, sf_dir):
    return rounded(filling.impute_mean(gappy_orders(spark, sf_dir)), ["o_custkey", "o_totalprice"], 4)


def _scaled(c, source):
    return f"round(({c} - (SELECT avg({c}) FROM {source})) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM {source}), 6) + 0.0"


SCALED = ["l_orderkey AS id", "l_quantity", "l_extendedprice", "l_discount", "3 AS l_constant", "l_returnflag"]
SCALED_SQL = derived_sql("lineitem", SCALED)
SCALED_NAMES = ["id", "l_quantity", "l_extendedprice", "l_discount", "l_constant"]


@query(
    "normalize",
    f"SELECT {', '.join(f'{_scaled(c, SCALED_SQL)} AS {c}' for c in SCALED_NAMES)}, l_returnflag FROM {SCALED_SQL}",
)
def normalize(spark, sf_dir):
    return rounded(filling.normalize(derived(spark, sf_dir, "lineitem", SCALED)), SCALED_NAMES)


_FILLED = f"""(SELECT o_orderkey, coalesce(CAST(g.o_custkey AS DOUBLE), m.o_custkey) AS o_custkey,
  coalesce(o_orderstatus, {_mode("o_orderstatus", GAPPY)}) AS o_orderstatus,
  coalesce(g.o_totalprice, m.o_totalprice) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
  coalesce(o_orderpriority, {_mode("o_orderpriority", GAPPY)}) AS o_orderpriority
  FROM {GAPPY} g, (SELECT {_MEDIANS} FROM {GAPPY}) m)"""


@query(
    "preprocess",
    f"""SELECT {_scaled("o_orderkey", "f")} AS o_orderkey, {_scaled("o_custkey", "f")} AS o_custkey, o_orderstatus,
    {_scaled("o_totalprice", "f")} AS o_totalprice, o_orderdate, o_orderpriority
    FROM f""".replace("SELECT", f"WITH f AS {_FILLED} SELECT", 1),
)
def preprocess_query(spark, sf_dir):
    return rounded(preprocess(gappy_orders(spark, sf_dir)), ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "standardize_types",
    """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
    CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS p_retailprice, p_size > 25 AS large, '2024-01-02' AS seen FROM part""",
)
def standardize_types(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mixed = part.withColumns(
        {
            "p_retailprice": F.col("p_retailprice").cast("float"),
            "large": F.col("p_size") > 25,
            "seen": F.lit("2024-01-02").cast("date"),
        }
    )
    return filling.standardize_types(mixed)


UNTIDY = ["doc_id", "concat('  ', upper(source), '   X ') AS source", "text", "lang"]
_CLEAN = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g'), ' '))"


@query(
    "clean_text",
    f"""SELECT doc_id, {', '.join(f'{_CLEAN.format(c)} AS {c}' for c in ("source", "text", "lang"))}
    FROM {derived_sql("documents", UNTIDY)}""",
)
def clean_text(spark, sf_dir):
    return filling.clean_texts(derived(spark, sf_dir, "documents", UNTIDY))


@query(
    "dedupe_rows",
    f"""SELECT min(doc_id) AS doc_id, text, lang, source, n_chars FROM
    (SELECT doc_id, {", ".join(f"{_CLEAN.format(c)} AS {c}" for c in ("text", "lang", "source"))}, n_chars FROM documents) GROUP BY ALL""",
)
def dedupe_rows(spark, sf_dir):
    return filling.dedupe_rows(filling.clean_texts(table(spark, sf_dir, "documents")), "doc_id")


@query(
    "dedupe_rows_by_columns",
    """SELECT min(event_id) AS event_id, arg_min(ts, event_id) AS ts, user_id, event_type, arg_min(value, event_id) AS value,
    arg_min(props, event_id) AS props FROM events GROUP BY user_id, event_type""",
)
def dedupe_rows_by_columns(spark, sf_dir):
    return filling.dedupe_rows(table(spark, sf_dir, "events"), "event_id", ["user_id", "event_type"])


@query(
    "clip_range",
    "SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 9000 THEN 9000 ELSE c_acctbal END AS c_acctbal) FROM customer",
)
def clip_range(spark, sf_dir):
    return filling.clip_range(table(spark, sf_dir, "customer"), "c_acctbal", 0, 9000)

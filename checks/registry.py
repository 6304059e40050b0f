"""Registration of queries and the tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL counterpart where there is one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derived tables: the same expressions run in Spark and in SQL. The given tables hold no nulls, so
# these put some in, always over the whole table.
GAPPY_ORDERS = [
    "o_orderkey",
    "CASE WHEN o_totalprice < 30000 THEN NULL ELSE o_custkey END AS o_custkey",
    "NULLIF(o_orderstatus, 'P') AS o_orderstatus",
    "CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "o_orderdate",
    "NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority",
]
MESSY_ORDERS = [
    "o_orderkey",
    "NULLIF(o_orderstatus, 'P') AS status",
    "CASE WHEN o_orderstatus IN ('P', 'F') THEN NULL ELSE o_totalprice END AS price",
    "CASE WHEN o_orderstatus = 'F' THEN lower(substr(o_orderpriority, 3)) ELSE substr(o_orderpriority, 3) END AS priority",
    "CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR(20)) ELSE o_orderpriority END AS code",
    "o_orderdate",
]


def derived(spark: SparkSession, sf_dir: str, name: str, expressions: list[str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*expressions)


def derived_sql(name: str, expressions: list[str]) -> str:
    return f"(SELECT {', '.join(expressions)} FROM {name})"


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "orders", GAPPY_ORDERS)


GAPPY = derived_sql("orders", GAPPY_ORDERS)


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "orders", MESSY_ORDERS)


MESSY = derived_sql("orders", MESSY_ORDERS)

COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "messy": ["o_orderkey", "status", "price", "priority", "code", "o_orderdate"],
    "lineitem": [
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    ],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
LINEITEM_NUMBERS = COLUMNS["lineitem"][:8]


def each(columns: list[str], one: Callable[[str], str]) -> str:
    """The SELECT for every column, one under the other."""
    return "\nUNION ALL\n".join(one(c) for c in columns)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; engines differ in the last bits of a sum. Never -0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})

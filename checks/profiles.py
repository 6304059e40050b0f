"""Profiling queries."""

from itertools import combinations

from pyspark.sql import functions as F

from checks.registry import (
    COLUMNS,
    GAPPY,
    LINEITEM_NUMBERS,
    derived,
    derived_sql,
    each,
    gappy_orders,
    query,
    rounded,
    table,
)
from plumbline.operators import correlation, frequencies, measures, quantiles
from plumbline.plans.profile_report import column_profile

ORDERS, LINEITEM, DOCUMENTS = COLUMNS["orders"], COLUMNS["lineitem"], COLUMNS["documents"]


@query(
    "null_profile",
    each(
        ORDERS,
        lambda c: f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percentage FROM {GAPPY}""",
    ),
)
def null_profile(spark, sf_dir):
    return measures.null_profile(gappy_orders(spark, sf_dir))


@query(
    "completeness",
    each(
        ORDERS,
        lambda c: f"""SELECT '{c}' AS "column", round(count({c})::DOUBLE / count(*), 6) AS completeness,
        CASE WHEN count({c})::DOUBLE / count(*) > 0.9 THEN 'success'
             WHEN count({c})::DOUBLE / count(*) > 0.7 THEN 'warning' ELSE 'danger' END AS band FROM {GAPPY}""",
    ),
)
def completeness(spark, sf_dir):
    return rounded(measures.completeness(gappy_orders(spark, sf_dir)), ["completeness"])


def _unique_sql(columns, source):
    return each(
        columns,
        lambda c: f"""SELECT '{c}' AS "column",
        (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::BIGINT AS unique_count,
        round((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) * 100.0::DOUBLE / count({c}), 2)
          AS unique_percentage,
        count(DISTINCT {c}) AS "unique", round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS unique_pct
        FROM {source}""",
    )


@query("unique_profile", _unique_sql(ORDERS, GAPPY))
def unique_profile(spark, sf_dir):
    return frequencies.unique_profile(gappy_orders(spark, sf_dir))


@query("unique_profile_documents", _unique_sql(DOCUMENTS, "documents"))
def unique_profile_documents(spark, sf_dir):
    return frequencies.unique_profile(table(spark, sf_dir, "documents"))


@query("unique_approx")
def unique_approx(spark, sf_dir):
    return frequencies.unique_approx(table(spark, sf_dir, "lineitem"))


def _counts_sql(columns, source):
    return each(
        columns,
        lambda c: f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS "count",
        round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {source}), 2) AS percentage
        FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}""",
    )


@query("value_counts", _counts_sql(ORDERS, GAPPY))
def value_counts(spark, sf_dir):
    return frequencies.value_counts(gappy_orders(spark, sf_dir))


@query("value_counts_documents", _counts_sql(DOCUMENTS, "documents"))
def value_counts_documents(spark, sf_dir):
    return frequencies.value_counts(table(spark, sf_dir, "documents"))


def _top_sql(columns, source, k=10):
    return each(
        columns,
        lambda c: f"""SELECT * FROM (SELECT '{c}' AS "column",
        CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS "rank", CAST({c} AS VARCHAR) AS value,
        count(*) AS "count", round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {source}), 2) AS percentage
        FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE "rank" <= {k}""",
    )


@query("top_values", _top_sql(LINEITEM, "lineitem"))
def top_values(spark, sf_dir):
    return frequencies.top_values(table(spark, sf_dir, "lineitem"))


@query("top_values_documents", _top_sql(DOCUMENTS, "documents"))
def top_values_documents(spark, sf_dir):
    return frequencies.top_values(table(spark, sf_dir, "documents"))


def _samples_sql(columns, source):
    return each(
        columns,
        lambda c: f"""SELECT '{c}' AS "column", string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) AS samples
        FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL ORDER BY v LIMIT 10)""",
    )


@query("sample_values_documents", _samples_sql(DOCUMENTS, "documents"))
def sample_values_documents(spark, sf_dir):
    samples = frequencies.sample_values(table(spark, sf_dir, "documents"))
    return samples.withColumn("samples", F.array_join("samples", "|"))


@query("sample_values", _samples_sql(ORDERS, GAPPY))
def sample_values(spark, sf_dir):
    samples = frequencies.sample_values(gappy_orders(spark, sf_dir))
    return samples.withColumn("samples", F.array_join("samples", "|"))


def _stats(c, digits=6):
    return f"""round(avg({c}), {digits}) AS mean, round(stddev_samp({c}), {digits}) AS std,
    round(CAST(min({c}) AS DOUBLE), {digits}) AS "min", round(CAST(max({c}) AS DOUBLE), {digits}) AS "max\""""


@query(
    "numeric_stats",
    each(["o_orderkey", "o_custkey", "o_totalprice"], lambda c: f"""SELECT '{c}' AS "column", {_stats(c, 4)} FROM {GAPPY}"""),
)
def numeric_stats(spark, sf_dir):
    return rounded(measures.numeric_stats(gappy_orders(spark, sf_dir)), ["mean", "std", "min", "max"], 4)


def _quartiles(c, digits=6):
    return ", ".join(
        f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), {digits}) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75)
    )


@query("quartiles", each(LINEITEM_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", {_quartiles(c)} FROM lineitem"""))
def quartiles(spark, sf_dir):
    return rounded(quantiles.quartiles(table(spark, sf_dir, "lineitem")), ["q25", "q50", "q75"])


@query(
    "quartiles_with_gaps",
    each(["o_orderkey", "o_custkey", "o_totalprice"], lambda c: f"""SELECT '{c}' AS "column", {_quartiles(c)} FROM {GAPPY}"""),
)
def quartiles_with_gaps(spark, sf_dir):
    return rounded(quantiles.quartiles(gappy_orders(spark, sf_dir)), ["q25", "q50", "q75"])


@query("quartiles_approx")
def quartiles_approx(spark, sf_dir):
    return quantiles.quartiles_approx(table(spark, sf_dir, "lineitem"))


# l_tax and l_quantity get gaps at different rows, and one column is constant.
CORRELATED = [
    "l_orderkey",
    "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS l_quantity",
    "l_extendedprice",
    "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_tax END AS l_tax",
    "l_extendedprice * 2 + l_tax AS l_double",
    "7 AS l_constant",
]
CORRELATED_SQL = derived_sql("lineitem", CORRELATED)
CORRELATED_NAMES = ["l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_double", "l_constant"]


def _pearson_sql(a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return f"""round(covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {both} THEN {a} END)
      * stddev_pop(CASE WHEN {both} THEN {b} END), 0), 6) + 0.0"""


@query(
    "correlations",
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, "
        + (f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0::DOUBLE END" if a == b else _pearson_sql(a, b))
        + f" AS correlation FROM {CORRELATED_SQL}"
        for a in CORRELATED_NAMES
        for b in CORRELATED_NAMES
    ),
)
def correlations(spark, sf_dir):
    return rounded(correlation.correlations(derived(spark, sf_dir, "lineitem", CORRELATED)), ["correlation"])


@query(
    "high_correlations",
    "SELECT * FROM (\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, {_pearson_sql(a, b)} AS correlation FROM {CORRELATED_SQL}"
        for a, b in combinations(CORRELATED_NAMES, 2)
    )
    + "\n) WHERE abs(correlation) > 0.7",
)
def high_correlations(spark, sf_dir):
    return rounded(correlation.high_correlations(derived(spark, sf_dir, "lineitem", CORRELATED)), ["correlation"])


_VARIANCES = each(LINEITEM_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", var_samp({c}) AS variance FROM lineitem""")


@query(
    "high_variance",
    f"""WITH v AS ({_VARIANCES}) SELECT "column", round(variance, 2) AS variance FROM v
    WHERE variance > (SELECT avg(variance) + stddev_samp(variance) FROM v)""",
)
def high_variance(spark, sf_dir):
    return rounded(correlation.high_variance(table(spark, sf_dir, "lineitem")), ["variance"], 2)


def _categories_sql(columns, source):
    return each(
        columns,
        lambda c: f"""SELECT '{c}' AS "column", count(*) AS unique_values,
        round(-sum(n::DOUBLE / total * log2(n::DOUBLE / total)), 6) AS distribution_entropy,
        (SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM
          (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 3))
          AS most_common
        FROM (SELECT {c} AS v, count(*) AS n, (SELECT count(*) FROM {source}) AS total FROM {source}
          WHERE {c} IS NOT NULL GROUP BY {c})""",
    )


def _categories(df):
    found = frequencies.category_statistics(df)
    shown = F.transform("most_common", lambda s: F.concat(s["value"], F.lit(":"), s["count"].cast("string")))
    return rounded(found.withColumn("most_common", F.array_join(shown, "|")), ["distribution_entropy"])


@query("category_entropy", _categories_sql(["o_orderstatus", "o_orderpriority"], GAPPY))
def category_entropy(spark, sf_dir):
    return _categories(gappy_orders(spark, sf_dir))


@query("category_entropy_documents", _categories_sql(["text", "lang", "source"], "documents"))
def category_entropy_documents(spark, sf_dir):
    return _categories(table(spark, sf_dir, "documents"))


_ROWS = f"SELECT {', '.join(ORDERS)}, count(*) AS n FROM {GAPPY} GROUP BY ALL"
_EMPTY = " + ".join(f"({c} IS NULL)::INT" for c in ORDERS)


@query(
    "table_summary",
    f"""SELECT sum(n)::BIGINT AS "rows", 6::BIGINT AS columns, sum(n * ({_EMPTY}))::BIGINT AS missing_cells,
    round(sum(n * ({_EMPTY})) * 100.0::DOUBLE / (sum(n) * 6), 2) AS missing_cells_pct,
    sum(n - 1)::BIGINT AS duplicate_rows, round(sum(n - 1) * 100.0::DOUBLE / sum(n), 2) AS duplicate_rows_pct
    FROM ({_ROWS})""",
)
def table_summary(spark, sf_dir):
    return measures.table_summary(gappy_orders(spark, sf_dir))


@query(
    "duplicate_rows",
    """SELECT sum(n - 1)::BIGINT AS duplicate_rows, round(sum(n - 1) * 100.0::DOUBLE / sum(n), 2) AS duplicate_rows_pct
    FROM (SELECT event_id, ts, user_id, event_type, value, props, count(*) AS n FROM
      (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value < 20) GROUP BY ALL)""",
)
def duplicate_rows(spark, sf_dir):
    """Whole rows, some of them twice."""
    events = table(spark, sf_dir, "events")
    return measures.duplicate_rows(events.union(events.where("value < 20")))


_TYPES = dict(
    zip(LINEITEM, ["bigint"] * 3 + ["int"] + ["double"] * 4 + ["string"] * 2 + ["timestamp_ntz"], strict=True)
)
_NO_NUMBERS = ", ".join(f'NULL::DOUBLE AS "{n}"' for n in ("mean", "std", "min", "max", "q25", "q50", "q75"))


@query(
    "column_profile",
    each(
        LINEITEM,
        lambda c: f"""SELECT '{c}' AS name, '{_TYPES[c]}' AS type, count(*) AS "count",
        count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
        count(DISTINCT {c}) AS "unique", round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS unique_pct,
        {f"{_stats(c, 4)}, {_quartiles(c, 4)}" if c in LINEITEM_NUMBERS else _NO_NUMBERS} FROM lineitem""",
    ),
)
def column_profile_query(spark, sf_dir):
    profile = column_profile(table(spark, sf_dir, "lineitem"))
    return rounded(profile, ["mean", "std", "min", "max", "q25", "q50", "q75"], 4)


_SHOWN = "string_agg(value || ':' || \"count\" || ':' || printf('%.2f', percentage), '|' ORDER BY \"rank\")"


@query(
    "column_profile_documents",
    f"""SELECT p.*, t.top_values FROM ({each(
        DOCUMENTS,
        lambda c: f"""SELECT '{c}' AS name, '{"bigint" if c in ("doc_id", "n_chars") else "string"}' AS type, count(*) AS "count",
        count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
        count(DISTINCT {c}) AS "unique", round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS unique_pct,
        {f"{_stats(c, 4)}, {_quartiles(c, 4)}" if c in ("doc_id", "n_chars") else _NO_NUMBERS} FROM documents""",
    )}) p JOIN (SELECT "column" AS name, {_SHOWN} AS top_values FROM ({_top_sql(DOCUMENTS, "documents", 5)}) GROUP BY 1) t USING (name)""",
)
def column_profile_documents(spark, sf_dir):
    """With the most frequent values of each column, of whole texts too."""
    profile = column_profile(table(spark, sf_dir, "documents"), top=5)
    shown = F.transform("top_values", lambda v: F.format_string("%s:%d:%.2f", v["value"], v["count"], v["percentage"]))
    profile = profile.withColumn("top_values", F.array_join(shown, "|"))
    return rounded(profile, ["mean", "std", "min", "max", "q25", "q50", "q75"], 4)


@query(
    "table_shape",
    """SELECT count(*) AS "rows", 11::BIGINT AS columns, '"""
    + ",".join(LINEITEM)
    + """' AS column_names FROM lineitem""",
)
def table_shape(spark, sf_dir):
    shape = measures.table_shape(table(spark, sf_dir, "lineitem"))
    return shape.withColumn("column_names", F.array_join("column_names", ","))

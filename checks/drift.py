"""Comparison of two snapshots: events before and after the middle of the month, and orders by year."""

from pyspark.sql import functions as F

from checks.registry import query, rounded, table
from plumbline.operators import drift
from plumbline.plans.comparison import comparison

CUT = "2024-01-16"
BEFORE, NOW = (f"(SELECT * FROM events WHERE ts {op} TIMESTAMP '{CUT}')" for op in ("<", ">="))


def _events(spark, sf_dir):
    """The later half lost a column, gained another, and calls some event types by another name."""
    events, cut = table(spark, sf_dir, "events"), F.lit(CUT).cast("timestamp_ntz")
    now = events.where(F.col("ts") >= cut).withColumn("event_type", F.expr(NEW_TYPE))
    return events.where(F.col("ts") < cut), now.withColumnRenamed("props", "details")


NEW_TYPE = "CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'view' AND value > 20 THEN 'click' ELSE event_type END"
NOW_RENAMED = f"(SELECT * REPLACE ({NEW_TYPE} AS event_type) FROM {NOW})"


@query(
    "drift_summary",
    f"""SELECT p.n AS previous_rows, c.n AS current_rows, c.n - p.n AS row_difference, 'details' AS new_columns,
    'props' AS missing_columns FROM (SELECT count(*) AS n FROM {BEFORE}) p, (SELECT count(*) AS n FROM {NOW}) c""",
)
def drift_summary(spark, sf_dir):
    summary = drift.drift_summary(*_events(spark, sf_dir))
    return summary.withColumns({c: F.array_join(c, ",") for c in ("new_columns", "missing_columns")})


@query(
    "drift_columns",
    f"""SELECT 'details' AS "column", 'new' AS change, count(props) AS "values" FROM {NOW}
    UNION ALL SELECT 'props', 'missing', count(props) FROM {BEFORE}""",
)
def drift_columns(spark, sf_dir):
    return drift.drift_columns(*_events(spark, sf_dir))


def _figures(source):
    one = """SELECT '{c}' AS "column", '{s}' AS stat, CAST({f}({c}) AS DOUBLE) AS x FROM {source}"""
    return "\nUNION ALL\n".join(
        one.format(c=c, s=s, f=f, source=source)
        for c in ("event_id", "user_id", "value")
        for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )


@query(
    "drift_numeric",
    f"""SELECT "column", stat, round(p.x, 4) AS previous, round(c.x, 4) AS "current",
    round(abs((c.x - p.x) / p.x) * 100, 4) AS percentage_change
    FROM ({_figures(BEFORE)}) p JOIN ({_figures(NOW)}) c USING ("column", stat)
    WHERE p.x <> 0 AND abs((c.x - p.x) / p.x) > 0.1""",
)
def drift_numeric(spark, sf_dir):
    moved = drift.drift_numeric(*_events(spark, sf_dir))
    return rounded(moved, ["previous", "current", "percentage_change"], 4)


def _counts(c, source):
    return f"(SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"


@query(
    "drift_categories",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(v AS VARCHAR) AS category, CASE WHEN p.n IS NULL THEN 'new' ELSE 'missing' END AS change
        FROM {_counts(c, BEFORE)} p FULL JOIN {_counts(c, NOW_RENAMED)} c USING (v) WHERE p.n IS NULL OR c.n IS NULL"""
        for c in ("ts", "event_type")
    ),
)
def drift_categories(spark, sf_dir):
    return drift.drift_categories(*_events(spark, sf_dir))


@query(
    "drift_distribution",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(v AS VARCHAR) AS category, round(b * 100, 6) AS previous_percentage,
        round(a * 100, 6) AS current_percentage, round((a - b) * 100, 6) AS difference FROM (
        SELECT v, p.n::DOUBLE / (SELECT count(*) FROM {BEFORE}) AS b, c.n::DOUBLE / (SELECT count(*) FROM {NOW}) AS a
        FROM {_counts(c, BEFORE)} p JOIN {_counts(c, NOW_RENAMED)} c USING (v)) WHERE abs(a - b) > 0.05"""
        for c in ("ts", "event_type")
    ),
)
def drift_distribution(spark, sf_dir):
    moved = drift.drift_distribution(*_events(spark, sf_dir), threshold=0.05)
    return rounded(moved, ["previous_percentage", "current_percentage", "difference"])


# Two snapshots of the documents that share a third of them.
OLD_DOCUMENTS, NEW_DOCUMENTS = (f"(SELECT * FROM documents WHERE doc_id % 3 <> {k})" for k in (0, 1))


@query(
    "drift_texts",
    f"""SELECT 'text' AS "column", v AS category, CASE WHEN p.n IS NULL THEN 'new' ELSE 'missing' END AS change
    FROM {_counts("text", OLD_DOCUMENTS)} p FULL JOIN {_counts("text", NEW_DOCUMENTS)} c USING (v) WHERE p.n IS NULL OR c.n IS NULL""",
)
def drift_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return drift.drift_categories(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 <> 1"), ["text"])


_COMPARED = f"""
SELECT 'columns' AS part, 'details' AS "column", 'values' AS item, NULL::DOUBLE AS "before", count(props)::DOUBLE AS "now", 'new' AS change FROM {NOW}
UNION ALL SELECT 'columns', 'props', 'values', NULL, count(props)::DOUBLE, 'missing' FROM {BEFORE}
UNION ALL SELECT 'numeric', "column", stat, round(p.x, 4), round(c.x, 4), printf('%.2f', abs((c.x - p.x) / p.x) * 100)
    FROM ({_figures(BEFORE)}) p JOIN ({_figures(NOW)}) c USING ("column", stat) WHERE p.x <> 0 AND abs((c.x - p.x) / p.x) > 0.05
""" + "".join(
    f"""UNION ALL SELECT 'categories', '{c}', CAST(v AS VARCHAR), NULL, NULL, CASE WHEN p.n IS NULL THEN 'new' ELSE 'missing' END
    FROM {_counts(c, BEFORE)} p FULL JOIN {_counts(c, NOW_RENAMED)} c USING (v) WHERE p.n IS NULL OR c.n IS NULL
UNION ALL SELECT 'distribution', '{c}', CAST(v AS VARCHAR), round(b * 100, 4), round(a * 100, 4), printf('%.2f', (a - b) * 100) FROM (
    SELECT v, p.n::DOUBLE / (SELECT count(*) FROM {BEFORE}) AS b, c.n::DOUBLE / (SELECT count(*) FROM {NOW}) AS a
    FROM {_counts(c, BEFORE)} p JOIN {_counts(c, NOW_RENAMED)} c USING (v)) WHERE abs(a - b) > 0.05
"""
    for c in ("ts", "event_type")
)


@query("comparison", _COMPARED)
def whole_comparison(spark, sf_dir):
    return rounded(comparison(*_events(spark, sf_dir), threshold=0.05), ["before", "now"], 4)

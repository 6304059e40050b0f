"""Quality metrics, issues and outliers."""

from pyspark.sql import functions as F

from checks.registry import COLUMNS, MESSY, each, messy_orders, query, rounded, table
from plumbline.operators import issues, outliers
from plumbline.plans.quality_report import quality_metrics

_MESSY_TYPES = dict(zip(COLUMNS["messy"], ["bigint", "string", "double", "string", "string", "timestamp_ntz"], strict=True))
_MESSY_BUCKETS = dict(zip(COLUMNS["messy"], ["numeric", "string", "numeric", "string", "string", "date"], strict=True))


@query(
    "quality_metrics",
    each(
        COLUMNS["messy"],
        lambda c: f"""SELECT '{c}' AS "column", '{_MESSY_TYPES[c]}' AS data_type, '{_MESSY_BUCKETS[c]}' AS bucket,
        count(*) AS total_rows, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percentage,
        (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::BIGINT AS unique_count,
        round((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) * 100.0::DOUBLE / count({c}), 2)
          AS unique_percentage,
        (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM
          (SELECT DISTINCT {c} AS v FROM {MESSY} WHERE {c} IS NOT NULL ORDER BY v LIMIT 10)) AS samples
        FROM {MESSY}""",
    ),
)
def quality_metrics_query(spark, sf_dir):
    metrics = quality_metrics(messy_orders(spark, sf_dir))
    return metrics.withColumn("samples", F.array_join("samples", "|"))


def _issues_sql(texts, numbers, others, source):
    def one(c):
        values = f"SELECT {c} AS v FROM {source} WHERE {c} IS NOT NULL"
        # The signs of a column that is not text stay at zero.
        signs = (
            f"""SELECT count(*) AS seen, count(*) FILTER (regexp_matches(v, '^-?\\d*\\.?\\d+$')) AS number_like,
            count(*) FILTER (v = upper(v) AND v <> lower(v)) AS up, count(*) FILTER (v = lower(v) AND v <> upper(v)) AS low,
            count(*) FILTER (regexp_matches(v, '[^a-zA-Z0-9\\s]')) AS special FROM ({values})"""
            if c in texts
            else "SELECT 0 AS seen, 0 AS number_like, 0 AS up, 0 AS low, 0 AS special"
        )
        return f"""SELECT '{c}' AS "column", {str(c in numbers).lower()} AS is_number, s.*, t.* FROM ({signs}) s, (
        SELECT count(*) AS n, count(*) - count({c}) AS nulls,
        count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS kinds, count(DISTINCT {c}) AS different
        FROM {source}) t"""

    return f"""WITH p AS ({each(texts + numbers + others, one)})
    SELECT "column", 'high_null_percentage' AS issue_type,
      printf('%.1f%% of the rows have no value', nulls * 100.0::DOUBLE / n) AS description,
      CASE WHEN nulls * 100.0 / n > 50 THEN 'high' ELSE 'medium' END AS severity FROM p WHERE nulls * 100.0 / n > 20
    UNION ALL SELECT "column", 'mixed_data_types', 'some values read as numbers, others do not', 'medium'
      FROM p WHERE number_like > 0 AND number_like < seen
    UNION ALL SELECT "column", 'inconsistent_casing', 'some values are in capitals, others in small letters', 'low'
      FROM p WHERE up > 0 AND low > 0
    UNION ALL SELECT "column", 'special_characters', 'values hold signs beyond letters, digits and blanks', 'low'
      FROM p WHERE special > 0
    UNION ALL SELECT "column", 'high_cardinality',
      printf('different values for %.1f%% of the rows', kinds * 100.0::DOUBLE / (n - nulls)), 'medium'
      FROM p WHERE NOT is_number AND different > 0 AND kinds * 100.0 / (n - nulls) > 90"""


@query("quality_issues", _issues_sql(["status", "priority", "code"], ["o_orderkey", "price"], ["o_orderdate"], MESSY))
def quality_issues(spark, sf_dir):
    return issues.quality_issues(messy_orders(spark, sf_dir))


@query("quality_issues_documents", _issues_sql(["text", "lang", "source"], ["doc_id", "n_chars"], [], "documents"))
def quality_issues_documents(spark, sf_dir):
    return issues.quality_issues(table(spark, sf_dir, "documents"))


def _anomaly_sql(c, mean, std):
    return f"""coalesce(abs({c} - {mean}) > 3 * {std}, false) AS {c}_is_anomaly,
    round(abs({c} - {mean}) / nullif(3 * {std}, 0), 6) AS {c}_anomaly_score,
    round(({c} - {mean}) / nullif({std}, 0), 6) + 0.0 AS {c}_zscore,
    coalesce(abs(({c} - {mean}) / nullif({std}, 0)) > 5, false) AS {c}_is_extreme"""


@query(
    "detect_anomalies",
    f"""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d, avg(user_id) AS um, stddev_samp(user_id) AS ud FROM events)
    SELECT events.*, {_anomaly_sql("value", "s.m", "s.d")}, {_anomaly_sql("user_id", "s.um", "s.ud")}
    FROM events, s""",
)
def detect_anomalies(spark, sf_dir):
    marked = outliers.detect_anomalies(table(spark, sf_dir, "events"), ["value", "event_type", "user_id"])
    return rounded(marked, [f"{c}_{s}" for c in ("value", "user_id") for s in ("anomaly_score", "zscore")])

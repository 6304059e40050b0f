"""The shape of the physical plans: what is read, what is shuffled, and that it stays in the engine."""

import re

import pytest
from pyspark.sql import functions as F

from checks.registry import QUERIES
from plumbline.operators import correlation, drift, filling, frequencies, measures, outliers, rules
from plumbline.plans.comparison import comparison
from plumbline.plans.quality_report import quality_metrics

# Row-wise Python, joins of everything with everything, and windows that gather a table in one task.
UNWANTED = re.compile(r"BatchEvalPython|ArrowEvalPython|PythonUDF|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin")
MANY = ["column_profile", "quality_metrics", "quality_issues", "correlations", "detect_anomalies", "normalize", "preprocess"]
MANY += ["drift_categories", "drift_numeric", "rule_expr_equal", "rule_unique", "top_values", "category_entropy", "dedupe_rows"]
MANY += ["latest_per_key", "detect_types", "type_advice", "clean_text", "flatten_json_text", "impute_mode", "impute_median"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def shuffles(df):
    return len(re.findall(r"\bExchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan(df)))


@pytest.mark.parametrize("name", MANY)
def test_stays_in_the_engine(spark, sf_dir, name):
    assert not UNWANTED.search(formatted(QUERIES[name](spark, sf_dir)))


def test_row_work_is_not_shuffled(read):
    orders = read("orders")
    for df in (
        filling.clean_texts(orders),
        filling.standardize_types(orders),
        filling.clip_range(orders, "o_totalprice", 0),
        rules.failing_rows(orders, [{"expectation_type": rules.NOT_NULL, "column": "o_custkey"}]),
    ):
        assert shuffles(df) == 0
    # the figures come from subqueries; the rows themselves stay where they are
    outer = formatted(outliers.detect_anomalies(orders, ["o_totalprice"])).split("===== Subqueries =====")[0]
    assert "Exchange" not in outer and "Subquery" in outer


def test_scans_read_their_columns_only(read):
    lineitem = read("lineitem")
    schema = r"ReadSchema: struct<([^>]*)>"
    (one,) = set(re.findall(schema, formatted(frequencies.frequency(lineitem, "l_tax"))))
    assert one == "l_tax:double"
    checks = [{"expectation_type": rules.BETWEEN, "kwargs": {"column": c, "min_value": 0}} for c in ("l_tax", "l_quantity")]
    (two,) = set(re.findall(schema, formatted(rules.validate(lineitem, checks))))
    assert two == "l_quantity:double,l_tax:double"


def test_filters_reach_the_scan(read):
    events = read("events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    before, now = events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)
    shown = formatted(drift.drift_categories(before, now, ["event_type"]))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in shown
    assert "GreaterThanOrEqual(ts" in shown


def test_all_rules_share_a_scan(read):
    lineitem = read("lineitem")
    listed = [{"expectation_type": rules.BETWEEN, "kwargs": {"column": "l_tax", "max_value": i}} for i in range(20)]
    assert plan(rules.validate(lineitem, listed)).count("FileScan") == 1
    assert shuffles(rules.validate(lineitem, listed)) == 1


def test_counting_combines_before_the_shuffle(read):
    shown = plan(frequencies.frequency(read("lineitem"), "l_returnflag"))
    assert shown.index("Exchange hashpartitioning") < shown.index("partial_count")


def test_top_values_keep_k_rows_per_task(read):
    assert "TakeOrderedAndProject(limit=10" in plan(frequencies.top_values(read("lineitem"), ["l_partkey"]))


def test_a_grouping_is_run_once(read):
    metrics = quality_metrics(read("orders"))
    metrics.collect()
    assert plan(metrics).count("ReusedExchange") >= 4


def test_counting_texts_does_not_ship_them(read):
    documents = read("documents")
    for df in (
        frequencies.distinct_counts(documents, ["text"]),
        measures.table_summary(documents),
        rules.validate(documents, [{"expectation_type": rules.UNIQUE, "column": "text"}]),
    ):
        assert "sha2" in plan(df)


def test_both_snapshots_share_a_grouping(read):
    events, documents = read("events"), read("documents")
    assert "Join" not in plan(drift.drift_categories(events, events, ["ts"]))
    # texts that changed are fetched by their keys: the sides themselves are not joined
    shown = plan(drift.drift_categories(documents, documents, ["text"]))
    assert set(re.findall(r"\w*Join\b", shown)) == {"BroadcastHashJoin"} and shown.count("BroadcastHashJoin") == 1


def test_the_whole_comparison_groups_a_column_once(read):
    events = read("events")
    compared = comparison(events, events.where("event_id % 2 = 0"))
    compared.collect()
    assert plan(compared).count("ReusedExchange") >= 4


@pytest.mark.parametrize("function", [frequencies.top_values, frequencies.sample_values, frequencies.category_statistics])
def test_whole_texts_are_only_moved_once_chosen(read, function):
    """Texts are grouped by key; whole ones enter a grouping above the filter that picks them, and none is sorted."""
    shown = formatted(function(read("documents"), ["text"]))
    assert "sha2" in shown and "SortAggregate" not in shown
    unpicked = re.findall(r"hashpartitioning\(text#", shown)
    assert not unpicked


def test_correlations_multiply_no_rows(read):
    shown = plan(correlation.correlations(read("lineitem")))
    assert "posexplode" not in shown and shown.count("MapInArrow") == shown.count("FileScan") == 1


def test_deduplication_needs_no_window(read):
    events = read("events")
    for df in (filling.dedupe_rows(events, "event_id"), filling.dedupe_rows(events, "event_id", ["user_id"])):
        assert "Window" not in plan(df) and shuffles(df) == 1


def test_one_pass_over_the_table_for_the_summary(read):
    assert plan(measures.table_summary(read("orders"))).count("FileScan") == 1

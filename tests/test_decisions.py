"""Nulls, NaN, no spread, no rows, ties: what each figure is then."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import columns, correlation, filling, frequencies, issues, measures, outliers, quantiles
from plumbline.operators.column_types import detect_types, type_advice
from plumbline.plans.preparation import preprocess
from plumbline.plans.profile_report import column_profile, profile_report
from plumbline.plans.quality_report import quality_report

NAN = float("nan")


def by_column(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1.0, 5.0, None, "b", True), (NAN, 5.0, None, "a", None), (3.0, 5.0, None, "b", False), (None, 5.0, None, "a", True)]
    return spark.createDataFrame(rows, "x double, same double, none string, word string, flag boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "x double, n int, word string, flag boolean")


def test_nan_is_null(odd):
    assert by_column(measures.null_profile(odd))["x"]["null_count"] == 2
    assert by_column(measures.numeric_stats(odd))["x"] | {"std": 0} == {"column": "x", "mean": 2.0, "std": 0, "min": 1.0, "max": 3.0}
    unique = by_column(frequencies.unique_profile(odd))["x"]
    assert (unique["unique_count"], unique["unique"], unique["unique_percentage"]) == (3, 2, 150.0)
    assert [r["value"] for r in frequencies.value_counts(odd, ["x"]).collect()] in (["1.0", "3.0"], ["3.0", "1.0"])


def test_no_values(odd):
    unique = by_column(frequencies.unique_profile(odd))["none"]
    assert (unique["unique_count"], unique["unique"], unique["unique_percentage"]) == (1, 0, None)
    assert by_column(frequencies.sample_values(odd))["none"]["samples"] == []
    assert by_column(detect_types(odd))["none"]["base_type"] == "unknown"
    assert by_column(type_advice(odd))["none"]["advice"] == "string"
    found = {(r["column"], r["issue_type"], r["severity"]) for r in issues.quality_issues(odd).collect()}
    assert ("none", "high_null_percentage", "high") in found
    assert ("none", "high_cardinality", "medium") not in found
    stats = by_column(frequencies.category_statistics(odd))["none"]
    assert (stats["unique_values"], stats["distribution_entropy"], stats["most_common"]) == (0, 0.0, [])


def test_no_rows(empty):
    assert by_column(measures.null_profile(empty))["x"] == {
        "column": "x",
        "total_rows": 0,
        "null_count": 0,
        "null_percentage": None,
    }
    assert by_column(measures.completeness(empty))["word"]["band"] == "danger"
    summary = measures.table_summary(empty).first().asDict()
    assert summary["rows"] == 0 and summary["missing_cells_pct"] is None
    assert quantiles.quantile_values(empty) == {"x": [None] * 3, "n": [None] * 3}
    profile = by_column(column_profile(empty), "name")
    assert len(profile) == 4 and profile["x"]["mean"] is None and profile["x"]["unique"] == 0
    assert issues.quality_issues(empty).count() == 0
    assert frequencies.top_values(empty).count() == 0
    assert preprocess(empty).count() == 0
    assert by_column(detect_types(empty))["n"]["base_type"] == "unknown"


def test_no_spread(odd):
    marked = outliers.detect_anomalies(odd, ["same", "word"])
    row = marked.first()
    assert (row["same_is_anomaly"], row["same_anomaly_score"], row["same_zscore"], row["same_is_extreme"]) == (False, None, None, False)
    assert "word_zscore" not in marked.columns
    assert {r["same"] for r in filling.normalize(odd).collect()} == {0.0}
    matrix = {(r["column1"], r["column2"]): r["correlation"] for r in correlation.correlations(odd).collect()}
    assert matrix["x", "x"] == pytest.approx(1.0) and matrix["x", "same"] is None and matrix["same", "same"] is None


def test_missing_value_is_no_anomaly(odd):
    rows = [r for r in outliers.detect_anomalies(odd, ["x"]).collect() if r["x"] is None or math.isnan(r["x"])]
    assert [(r["x_is_anomaly"], r["x_zscore"]) for r in rows] == [(False, None)] * 2


def test_ties_take_the_smallest(odd):
    tops = [(r["rank"], r["value"], r["count"]) for r in frequencies.top_values(odd, ["word"]).collect()]
    assert sorted(tops) == [(1, "a", 2), (2, "b", 2)]
    assert odd.select(filling.mode_of(odd, "word")).first()[0] == "a"


def test_booleans_are_categories(odd):
    assert columns.numeric_columns(odd) == ["x", "same"]
    assert "flag" not in by_column(measures.numeric_stats(odd))
    filled = filling.impute_mode(odd).select("flag", "none").collect()
    assert [r["flag"] for r in filled].count(True) == 3
    assert {r["none"] for r in filled} == {"Unknown"}


def test_filling_leaves_whole_columns_alone(spark):
    frame = spark.createDataFrame([(2**60 + 1, 1), (2**60 + 3, None)], "big long, gaps int")
    for fill in (filling.impute_median, filling.impute_mean):
        filled = fill(frame)
        assert dict(filled.dtypes) == {"big": "bigint", "gaps": "double"}
        assert {r["big"] for r in filled.collect()} == {2**60 + 1, 2**60 + 3}


def test_more_nulls_than_values_in_the_top(spark):
    frame = spark.createDataFrame([(None,)] * 5 + [("a",), ("b",), ("b",)], "w string")
    assert [(r["value"], r["count"]) for r in frequencies.top_values(frame, k=2).orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    assert by_column(frequencies.sample_values(frame, k=1))["w"]["samples"] == ["a"]


def test_entropy_is_over_all_rows(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "w string")
    stats = frequencies.category_statistics(frame).first()
    assert stats["distribution_entropy"] == pytest.approx(0.5 * 1 + 0.25 * 2)


def test_pairwise_complete_correlation(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (100.0, None), (None, 50.0), (4.0, 3.0)]
    frame = spark.createDataFrame(rows, "a double, b double")
    assert correlation.high_correlations(frame, above=0.5).first()["correlation"] == pytest.approx(0.6)


def test_nested_and_odd_columns(spark):
    frame = spark.sql(
        """select array(1, 2) as list, named_struct('a', 1) as box, map('k', 1) as m, date'2024-01-01' as day,
        cast('x' as binary) as bytes, 1.5bd as price, parse_json('{"a":1}') as v union all
        select array(1, 2), named_struct('a', 1), map('k', 1), date'2024-01-01', cast('x' as binary), 1.5bd, parse_json('{"a":1}')"""
    )
    assert measures.duplicate_rows(frame).first()["duplicate_rows"] == 1
    counts = by_column(frequencies.value_counts(frame))
    assert counts["list"]["value"] == "[1,2]" and counts["m"]["value"] == '{"k":1}' and counts["price"]["value"] == "1.5"
    assert {r["unique"] for r in frequencies.unique_profile(frame).collect()} == {1}
    assert len(by_column(column_profile(frame), "name")) == 7


def test_column_names_with_dots_and_blanks(spark):
    frame = spark.createDataFrame([(1.0, "x"), (None, "y")], "`a.b c` double, `d``e` string")
    assert by_column(measures.null_profile(frame))["a.b c"]["null_count"] == 1
    assert by_column(frequencies.unique_profile(frame))["d`e"]["unique"] == 2
    assert quantiles.quantile_values(frame) == {"a.b c": [1.0, 1.0, 1.0]}
    assert [r["a.b c"] for r in filling.impute_median(frame).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError, match="no column 'z'"):
        measures.null_profile(frame, ["z"])


def test_reports(odd):
    report = profile_report(odd)
    assert report["summary"].first()["duplicate_rows"] == 0
    assert by_column(report["columns"], "name")["x"]["q50"] == 2.0
    quality = quality_report(odd, [{"expectation_type": "expect_column_values_to_not_be_null", "column": "x"}])
    assert by_column(quality["metrics"])["word"]["samples"] == ["a", "b"]
    assert quality["rules"].first()["unexpected_count"] == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, read, parts):
    events = read("events").drop("ts")
    spread = events.repartition(parts)
    for figure in (frequencies.unique_profile, frequencies.top_values, frequencies.sample_values, quantiles.quartiles, issues.quality_issues):
        assert sorted(map(repr, figure(events).collect())) == sorted(map(repr, figure(spread).collect()))


def test_wide_table(spark):
    wide = spark.range(50).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(1, 61)])
    assert len(by_column(measures.numeric_stats(wide))) == 60
    assert by_column(measures.numeric_stats(wide))["c60"]["max"] == 49 * 60.0
    assert measures.null_profile(wide).count() == 60


def test_long_texts_count_like_short_ones(spark):
    long, digest_like = "x" * 500, "sha2:" + "0" * 64
    words = [long, long, long + "y", digest_like, "short", None, "9" * 80, "0." + "0" * 70 + "25"]
    frame = spark.createDataFrame([(w, w.encode() if w else None) for w in words], "w string, b binary")
    unique = by_column(frequencies.unique_profile(frame))
    assert unique["w"]["unique"] == unique["b"]["unique"] == 6 and unique["w"]["unique_count"] == 7
    assert measures.duplicate_rows(frame).first()["duplicate_rows"] == 1
    numbers = frame.where("w rlike '^[0-9.]+$'")
    found = by_column(detect_types(numbers, ["w"]))["w"]
    assert (found["base_type"], found["specific_type"]) == ("numeric", "float") and found["unique_ratio"] == 1.0
    assert found["sample_format"].startswith("0." + "0" * 70 + "25")
    assert by_column(detect_types(frame, ["w"]))["w"]["base_type"] == "string"


@pytest.mark.parametrize("different", [0, 3, 10, 11, 500])
def test_smallest_texts(spark, different):
    words = [f"w{i:04d}" for i in range(different)] * 3 + ["w0000"] * (200 if different else 0) + [None] * 5
    frame = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    assert by_column(frequencies.sample_values(frame))["w"]["samples"] == sorted({w for w in words if w})[:10]

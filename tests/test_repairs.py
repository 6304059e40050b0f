"""Cases that gave silently wrong results once."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import clean_text
from plumbline.operators.column_types import detect_types
from plumbline.operators.correlation import correlations
from plumbline.operators.expressions import add_expression
from plumbline.operators.issues import quality_issues
from plumbline.operators.rules import failing_rows, unexpected_values, validate
from plumbline.sources.files import scan_csv


def rule(kind, rule_id="r", **kwargs):
    return {"expectation_type": kind, "kwargs": kwargs, "rule_id": rule_id}


def test_issues_look_at_every_row(spark):
    rows = [(str(i),) for i in range(100, 400)] + [("zebra",)]
    found = {r["issue_type"] for r in quality_issues(spark.createDataFrame(rows, "x string")).collect()}
    assert "mixed_data_types" in found


def test_products_beyond_32_bits(spark):
    df = spark.createDataFrame([(3000, 2_000_000, 6_000_000_000)], "a int, b int, c long")
    assert add_expression(df, "p", "a * b").first()["p"] == 6_000_000_000
    same = rule("expect_column_pair_values_to_be_equal", column_A="c", column_B="a * b")
    assert validate(df, [same]).first()["unexpected_count"] == 0


def test_powers_and_quotients_beyond_doubles(spark):
    df = spark.createDataFrame([(1e300, 1e-300)], "a double, b double")
    assert add_expression(df, "p", "a ** 2").first()["p"] is None
    assert add_expression(df, "p", "a // 1").first()["p"] == 1e300


def test_texts_are_compared_as_texts(spark):
    df = spark.createDataFrame([("abc", "xyz", 1), ("q", "q", 2)], "a string, b string, n int")
    pair = "expect_column_pair_values_to_be_equal"
    assert validate(df, [rule(pair, column_A="a", column_B="b")]).first()["unexpected_count"] == 1
    assert validate(df, [rule(pair, column_A="a", column_B="n")]).first()["unexpected_count"] == 2


def test_failing_rows_of_a_hot_duplicate(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), "id")
    unique = rule("expect_column_values_to_be_unique", column="k")
    found = failing_rows(df, [unique])
    assert found.count() == 1000 and found.columns == ["k", "id", "failed_rules"]
    assert unexpected_values(df, [unique]).collect() == [("r", "k", "7", 1000)]
    with pytest.raises(ValueError, match="whole table"):
        failing_rows(df, [rule("expect_table_row_count_to_be_between", min_value=1)])


def test_unexpected_values(spark):
    df = spark.createDataFrame([(1,), (5,), (5,), (None,)], "x int")
    found = unexpected_values(df, [rule("expect_column_values_to_be_between", column="x", max_value=3)])
    assert found.collect() == [("r", "x", "5", 2)]


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_csv_files_in_two_column_orders(spark, tmp_path):
    rows = scan_csv(spark, write(tmp_path, a="x,y\n1,a\n", b="y,x\nb,2\n"))
    assert sorted((r["x"], r["y"]) for r in rows.collect()) == [(1, "a"), (2, "b")]


def test_csv_files_with_other_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="other columns"):
        scan_csv(spark, write(tmp_path, a="x,y\n1,a\n", b="x,z\n1,2\n"))


def test_csv_row_that_is_too_long_behind_an_empty_cell(spark, tmp_path):
    with pytest.raises(Exception, match="more cells than columns"):
        scan_csv(spark, write(tmp_path, a="x,y,z\n1,2,,9\n")).collect()


def test_csv_open_quote(spark, tmp_path):
    path = write(tmp_path, a='x,y\n1,"two\nlines"\n')
    with pytest.raises(ValueError, match="multi_line"):
        scan_csv(spark, path)
    assert scan_csv(spark, path, multi_line=True).first()["y"] == "two\nlines"


def test_declared_whole_numbers_stay_numbers(spark):
    found = detect_types(spark.createDataFrame([(0,), (1,)], "x int")).first().asDict()
    assert "boolean" not in found.values()


def test_other_blanks(spark):
    df = spark.createDataFrame([("A  b ",)], "x string")
    assert df.select(clean_text(F.col("x"))).first()[0] == "a b"


def test_correlation_scans_the_table_few_times(spark, tmp_path):
    spark.range(50).select(*[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(1, 41)]).write.parquet(f"{tmp_path}/t")
    plan = correlations(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3

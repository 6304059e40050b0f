"""Mixed and untidy input: stray quotes, JSON of several shapes, texts beside numbers, sets as frames, advice, row keys."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import column_types, filling, measures, nested, rules
from plumbline.sources.files import scan_csv

PAIR = {"expectation_type": rules.PAIR_EQUAL, "column_A": "a", "column_B": "b"}


def written(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_an_inch_sign_is_no_quote(spark, tmp_path):
    path = written(tmp_path, a='id,name,size\n1,MacBook Pro  16",5" pipe\n2,"a, ""b""",\n3,"x"y,z"\n')
    rows = scan_csv(spark, path).orderBy("id").collect()
    assert [tuple(r)[:2] for r in rows][:2] == [(1, 'MacBook Pro  16"'), (2, 'a, "b"')] and rows[0]["size"] == '5" pipe' and rows[1]["size"] is None
    assert rows[2]["size"] == 'z"'


@pytest.mark.parametrize("line", ['1,"open', '1,"a,b', '"1,2', '1,"a""'])
def test_a_quote_left_open_is_an_error(spark, tmp_path, line):
    with pytest.raises(ValueError, match="left open"):
        scan_csv(spark, written(tmp_path, a=f"id,name\n{line}\n"))


def test_files_of_several_column_orders(spark, tmp_path):
    path = written(tmp_path, a="id,x,y\n1,a,2.5\n", b="y,id,x\n3.5,2,b\n", c="id,x,y\n3,,\n", d="x,y,id\n")
    assert sorted(map(tuple, scan_csv(spark, path).select("id", "x", "y").collect())) == [(1, "a", 2.5), (2, "b", 3.5), (3, None, None)]
    with pytest.raises(ValueError, match="other columns"):
        scan_csv(spark, written(tmp_path, e="id,x,z\n1,a,2\n"))


def test_json_of_several_shapes(spark):
    texts = ['{"k": 1, "n": {"m": [1, 2]}}', '{"k": "x"}', "[1, 2.5]", "[]", "7", "plain", None, "{broken"]
    flat = nested.flatten_json_text(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "j").orderBy("id")
    assert flat.columns == ["id", "j_value", "j_k", "j_n_m_length", "j_n_m_items", "j_length", "j_items"]
    rows = flat.collect()
    assert [r["j_k"] for r in rows] == ["1", "x"] + [None] * 6
    assert [r["j_length"] for r in rows] == [None, None, 2, 0, None, None, None, None]
    assert [r["j_value"] for r in rows] == [None, None, None, None, "7", "plain", None, "{broken"]
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("parseJson", plan, re.IGNORECASE)) == 1


def test_arrays_and_objects_with_the_same_names(spark):
    texts = [('{"k": 1, "length": 2}',), ('[{"k": "a"}, {"k": null}]',)]
    flat = nested.flatten_json_text(spark.createDataFrame(texts, "j string"), "j")
    rows = flat.orderBy(F.col("j_k").asc_nulls_last()).collect()
    assert (rows[0]["j_k"], rows[0]["j_length"], rows[0]["j_list_k"]) == (1, 2, None)
    assert rows[1]["j_list_k"] == ["a", None]


def test_texts_beside_one_number(spark):
    df = spark.createDataFrame([("abc", "xyz"), ("5", "5.0"), ("q", "r"), ("same", "same"), (None, None), ("x", None)], "a string, b string")
    row = rules.validate(df, [PAIR]).first()
    assert (row["missing_count"], row["unexpected_count"], row["success"]) == (1, 3, False)
    numbers = spark.createDataFrame([(5.0, "5"), (5.0, "five"), (None, "5")], "a double, b string")
    assert rules.validate(numbers, [PAIR]).first()["unexpected_count"] == 2


@pytest.mark.parametrize("few", [True, False])
def test_sets_that_are_frames(spark, few, monkeypatch):
    monkeypatch.setattr(rules, "BROADCAST_ROWS", 200_000 if few else 1)
    long = "a text of more than sixty-four bytes, which is known by its digest " * 2
    df = spark.createDataFrame([(1, long), (2, "b"), (2, None), (None, long + "!"), (3, "2")], "n int, w string")
    numbers = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x bigint")
    words = spark.createDataFrame([(long,), ("b",)], "x string")

    def of(column, values):
        return {"expectation_type": rules.IN_SET, "column": column, "value_set": values, "rule_id": "r"}

    row = rules.validate(df, [of("n", numbers)]).first()
    assert (row["element_count"], row["missing_count"], row["unexpected_count"]) == (5, 1, 1)
    assert rules.validate(df, [of("w", words)]).first()["unexpected_count"] == 2
    # numbers are no texts
    assert rules.validate(df, [of("w", numbers)]).first()["unexpected_count"] == 4
    assert [r["n"] for r in rules.failing_rows(df, [of("n", numbers)]).collect()] == [3]
    assert [(r["value"], r["count"]) for r in rules.unexpected_values(df, [of("n", numbers)]).collect()] == [("3", 1)]
    numbers.write.mode("overwrite").saveAsTable("allowed_numbers")
    assert rules.validate(df, [of("n", {"table": "allowed_numbers", "column": "x"})]).first()["unexpected_count"] == 1
    spark.sql("DROP TABLE allowed_numbers")


def test_advice_is_applied_with_a_check(spark):
    df = spark.createDataFrame([(1, 300, 0.5, 2.0, "x"), (2, -1, 0.25, 3.0, "y")], "a bigint, b bigint, c double, d double, e string")
    advised = column_types.apply_advice(df)
    assert dict(advised.dtypes) == {"a": "smallint", "b": "smallint", "c": "float", "d": "smallint", "e": "string"}
    assert sorted(map(tuple, advised.collect())) == sorted(map(tuple, df.collect()))
    # rows that changed after the advice: the cast refuses to lose a value
    shifting = df.withColumn("a", F.when(F.rand() < 2, F.col("a")))
    original = column_types.type_advice
    try:
        column_types.type_advice = lambda frame, names: original(df.limit(1), names)
        with pytest.raises(PySparkException, match="loses"):
            column_types.apply_advice(shifting.union(spark.createDataFrame([(10**9, 1, 0.1, 1.0, "z")], df.schema))).collect()
    finally:
        column_types.type_advice = original


def test_rows_are_told_apart_by_their_values(spark):
    rows = [("1:a", None, 0.0), ("1:a", None, -0.0), ("1", ":a", 0.0), (None, "1:a", 0.0), ("-", None, float("nan")), (None, None, None), ("-", None, None), ("1:a", None, 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    # 0.0 is -0.0, NaN is null, and no two other rows are alike
    assert measures.duplicate_rows(df).first()["duplicate_rows"] == 3
    kept = filling.dedupe_rows(df.withColumn("id", F.monotonically_increasing_id()), "id", ["a", "b", "c"])
    assert kept.count() == 5

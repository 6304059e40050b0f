import json

import pytest

from plumbline.operators import rules
from plumbline.operators.expressions import add_expression, expression
from plumbline.operators.record_schema import schema_check
from plumbline.operators.sentences import sentence_rules
from plumbline.plans.validation import validate_table


def results(df):
    return {r["rule_id"]: r for r in df.collect()}


def one(frame, kind, **kwargs):
    meta = kwargs.pop("meta", {})
    return rules.validate(frame, [{"expectation_type": kind, "kwargs": kwargs, "meta": meta}]).first()


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("$10.00", 2, "20.0", "2024-01-01", "yes", 86400),
        ("(5)", 3, "-15", "01/02/2024", "no", None),
        ("50%", 4, "2.0", None, "yes", 0),
        ("junk", 5, None, "2024-01-04", None, 1),
        ("7", None, "7", "2024-01-05", "t", 2),
    ]
    return spark.createDataFrame(rows, "`unit price` string, qty int, total string, day string, paid string, n long")


def test_three_layouts():
    entry = {"expectation_type": rules.NOT_NULL, "kwargs": {"column": "x"}, "rule_id": "a"}
    flat = {"expectation_type": rules.NOT_NULL, "column": "x", "mostly": 0.5}
    assert [r.rule_id for r in rules.read_rules({"rules": [entry]})] == ["a"]
    assert rules.read_rules([entry])[0].kwargs == {"column": "x"}
    assert rules.read_rules({"expectations": [flat]})[0].kwargs == {"column": "x", "mostly": 0.5}
    assert [r.rule_id for r in rules.read_rules([flat, flat])] == ["rule_1", "rule_2"]


def test_inputs_are_not_changed(sales):
    listed = [{"expectation_type": rules.PAIR_EQUAL, "kwargs": {"column_A": "total", "column_B": "unit price * qty"}}]
    before = json.dumps(listed)
    validate_table(sales, listed).collect()
    assert json.dumps(listed) == before


def test_expression_over_text_columns(sales):
    # 10*2=20 holds, -5*3=-15 holds, 0.5*4=2 holds, junk: both missing, 7*null is missing but total is not
    row = validate_table(sales, [{"expectation_type": rules.PAIR_EQUAL, "kwargs": {"column_A": "total", "column_B": "unit price * qty"}}]).first()
    assert (row["element_count"], row["missing_count"], row["unexpected_count"], row["success"]) == (5, 1, 1, False)


def test_eval_and_rounding(spark):
    frame = spark.createDataFrame([(0.333,), (0.34,)], "a double")
    setting = {"column_A": "a", "value": {"$eval": "1 / 3"}}
    assert one(frame, rules.PAIR_EQUAL, **setting)["unexpected_count"] == 2
    assert one(frame, rules.PAIR_EQUAL, **setting, meta={"decimal_places": 2})["unexpected_count"] == 1


def test_pair_of_dates_in_a_format(spark):
    frame = spark.createDataFrame([("05/03/2024", "2024-03-05"), ("06/03/2024", "2024-03-07")], "a string, b string")
    days = frame.selectExpr("a", "cast(b as date) as b")
    assert one(days, rules.PAIR_EQUAL, column_A="a", column_B="b", meta={"date_format": "%d/%m/%Y"})["unexpected_count"] == 1
    assert one(days, rules.PAIR_EQUAL, column_A="a", column_B="b")["unexpected_count"] == 2


def test_date_arithmetic(spark):
    frame = spark.sql("select timestamp_ntz'2024-01-02 00:00:00' as sent, date'2024-01-01' as ordered")
    assert one(frame, rules.PAIR_EQUAL, column_A="sent", column_B="ordered + 86400")["success"]


def test_mostly_counts_rows_looked_at(spark):
    frame = spark.createDataFrame([(1,), (2,), (300,), (None,)], "x int")
    assert one(frame, rules.BETWEEN, column="x", min_value=0, max_value=10, mostly=0.66)["success"]
    assert not one(frame, rules.BETWEEN, column="x", min_value=0, max_value=10, mostly=0.67)["success"]
    assert one(frame, rules.NOT_NULL, column="x", mostly=0.75)["success"]
    assert not one(frame, rules.NOT_NULL, column="x", mostly=0.76)["success"]


def test_nothing_to_look_at_holds(spark):
    frame = spark.createDataFrame([(None,)], "x int")
    row = one(frame, rules.BETWEEN, column="x", min_value=0)
    assert (row["success"], row["missing_count"], row["unexpected_percent"]) == (True, 1, None)
    assert one(frame, rules.UNIQUE, column="x")["success"]
    assert not one(frame, rules.MEAN_BETWEEN, column="x", min_value=0)["success"]


def test_unique_counts_every_copy(spark):
    frame = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "x int")
    row = one(frame, rules.UNIQUE, column="x")
    assert (row["missing_count"], row["unexpected_count"], row["unexpected_percent"]) == (2, 3, 75.0)


def test_kinds_do_not_mix(spark):
    frame = spark.createDataFrame([("1", 1), ("x", 2)], "t string, n int")
    assert one(frame, rules.IN_SET, column="t", value_set=[1, "x"])["unexpected_count"] == 1
    assert one(frame, rules.IN_SET, column="n", value_set=["1", 2])["unexpected_count"] == 1
    assert one(frame, rules.IN_SET, column="n", value_set=["1"])["unexpected_count"] == 2
    assert one(frame, rules.BETWEEN, column="t", min_value=0, max_value=5)["unexpected_count"] == 1


def test_strict_bounds(spark):
    frame = spark.createDataFrame([(1,), (2,)], "n int")
    assert one(frame, rules.GREATER, column="n", value=1)["unexpected_count"] == 1
    assert one(frame, rules.LESS, column="n", value=3)["success"]


def test_errors_name_the_trouble(sales):
    with pytest.raises(ValueError, match="no column 'nope'"):
        one(sales, rules.NOT_NULL, column="nope")
    with pytest.raises(ValueError, match="unknown rule type"):
        one(sales, "expect_magic", column="qty")
    with pytest.raises(ValueError, match="names no column"):
        one(sales, rules.NOT_NULL)


def test_many_rules_in_one_call(sales):
    listed = [{"expectation_type": rules.BETWEEN, "kwargs": {"column": "qty", "max_value": i}} for i in range(60)]
    counted = [r["unexpected_count"] for r in sorted(rules.validate(sales, listed).collect(), key=lambda r: int(r["rule_id"][5:]))]
    assert counted == [sum(q > i for q in (2, 3, 4, 5)) for i in range(60)]


def test_sentences(spark):
    frame = spark.createDataFrame([(25.0, 50000, "Alice"), (40.0, 120000, ""), (None, 20000, "Charlie")], "age double, salary long, name string")
    said = [
        "The 'age' column should not be null",
        "The 'salary' column should be between 30000 and 120000",
        "The 'name' column should not be empty",
        "The 'NAME' column should be nice",
        "the 'Salary' column should be greater than 20000",
        "the 'salary' column should be less than 20000",
    ]
    found = results(rules.validate(frame, sentence_rules(said)))
    assert {k: r["unexpected_count"] for k, r in found.items()} == {
        "sentence_1": 1,
        "sentence_2": 1,
        "sentence_3": 0,
        "sentence_3_blank": 1,
        "sentence_5": 1,
        "sentence_6": 3,
    }
    summary = rules.suite_summary(rules.validate(frame, sentence_rules(said))).first()
    assert (summary["evaluated"], summary["successful"], summary["success"]) == (6, 1, False)


def test_failing_rows(sales):
    listed = [
        {"rule_id": "q", "expectation_type": rules.BETWEEN, "kwargs": {"column": "qty", "max_value": 3}},
        {"rule_id": "d", "expectation_type": rules.NOT_NULL, "kwargs": {"column": "day"}},
    ]
    assert sorted((r["qty"], r["failed_rules"]) for r in rules.failing_rows(sales, listed).collect()) == [(4, ["q", "d"]), (5, ["q"])]


def test_schema_check(spark):
    frame = spark.createDataFrame([("1", "a@b.co", 5.0, "2024-01-01T00:00:00"), ("x", "nobody", 500.0, "late")], "id string, email string, age double, at string")
    schema = {
        "properties": {
            "id": {"type": "integer", "minimum": 1},
            "email": {"type": "string", "format": "email", "maxLength": 6},
            "age": {"type": "integer", "maximum": 150},
            "at": {"format": "date-time"},
            "gone": {"type": "string"},
        },
        "required": ["id", "gone"],
    }
    failed = {k: r["unexpected_count"] for k, r in results(schema_check(frame, schema)).items()}
    assert failed == {
        "id.required": 0,
        "gone.required": 2,
        "id.type": 1,
        "id.minimum": 1,
        "email.type": 0,
        "email.maxLength": 0,
        "email.format": 1,
        "age.type": 0,
        "age.maximum": 1,
        "at.format": 1,
    }


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a + b * 2", 17.0),
        ("(a + b) * 2 - -1", 21.0),
        ("a / zero", None),
        ("a // b", 0.0),
        ("-a % b", 4.0),
        ("a ** 2", 9.0),
        ("a = 3", 1),
        ("a >= b", 0),
        ("`x y` + 1", 11),
        ("x y + 1", 11),
        ("a_b + a", 103.0),
        ("big + big", None),
    ],
)
def test_arithmetic(spark, text, expected):
    frame = spark.createDataFrame([(3.0, 7.0, 0, 10, 100, 2**62)], "a double, b double, zero int, `x y` int, a_b int, big long")
    assert add_expression(frame, "e", text).first()["e"] == expected


@pytest.mark.parametrize("text", ["missing + 1", "upper(a)", "a; drop", "a if b else a", "'x' + a", "a.b", "a +", "exists"])
def test_only_arithmetic_is_let_in(spark, text):
    frame = spark.createDataFrame([(3.0, 7.0)], "a double, b double")
    with pytest.raises(ValueError):
        expression(frame, text)

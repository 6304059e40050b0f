import pytest

from plumbline.operators import drift
from plumbline.plans.comparison import compare
from plumbline.plans.insights import column_insights


@pytest.fixture(scope="module")
def sides(spark):
    before = [(1.0, 0, "a", True, 1), (3.0, 0, "a", True, 1), (2.0, 0, "b", False, 1), (None, 0, None, None, 1)]
    now = [(1.0, 5, "a", True, "1"), (9.0, 5, "c", True, "2")]
    return (
        spark.createDataFrame(before, "x double, zero int, w string, flag boolean, kind int"),
        spark.createDataFrame(now, "x double, zero int, w string, flag boolean, kind string"),
    )


def test_comparison(sides):
    report = compare(*sides)
    assert report["summary"].first()["row_difference"] == -2
    assert report["columns"].count() == 0
    moved = {(r["column"], r["stat"]): r for r in report["numeric"].collect()}
    # nothing is said about figures that were zero before, nor about the minimum, which did not move
    assert set(moved) == {("x", "mean"), ("x", "std"), ("x", "max")}
    assert moved["x", "mean"]["percentage_change"] == pytest.approx(150.0)
    assert moved["x", "max"]["previous"] == 3.0 and moved["x", "max"]["current"] == 9.0
    changed = {(r["column"], r["category"]): r["change"] for r in report["categories"].collect()}
    # a column that is a number on one side only is compared as text
    assert changed == {("w", "b"): "missing", ("w", "c"): "new", ("flag", "false"): "missing", ("kind", "2"): "new"}
    shares = {(r["column"], r["category"]): r["difference"] for r in report["distribution"].collect()}
    # shares are of all rows, nulls included; "a" stays at one half
    assert shares == {("flag", "true"): pytest.approx(50.0), ("kind", "1"): pytest.approx(-50.0)}


def test_new_and_missing_columns(sides):
    before, now = sides
    changes = drift.drift_columns(before.drop("w"), now.drop("x"))
    assert {(r["column"], r["change"], r["values"]) for r in changes.collect()} == {("w", "new", 2), ("x", "missing", 3)}


@pytest.mark.parametrize("threshold", [0, 1, -0.5, 2])
def test_threshold_lies_between_zero_and_one(sides, threshold):
    with pytest.raises(ValueError, match="between 0 and 1"):
        compare(*sides, threshold)


def test_a_threshold_of_ones_own(sides):
    assert drift.drift_numeric(*sides, threshold=0.99).count() == 3
    assert drift.drift_distribution(*sides, threshold=0.5).count() == 0


def test_empty_side(sides):
    before, now = sides
    assert drift.drift_numeric(before, now.limit(0)).count() == 0
    assert {r["change"] for r in drift.drift_categories(before, now.limit(0)).collect()} == {"missing"}
    assert drift.drift_distribution(before, now.limit(0)).count() == 0


def test_insights(spark):
    rows = [(float(i), 2.0 * i + 1, float(i % 2), 1e6 * i, "ab"[i % 2]) for i in range(20)]
    found = column_insights(spark.createDataFrame(rows, "a double, b double, c double, big double, w string"))
    pairs = {(r["column1"], r["column2"]) for r in found["high_correlations"].collect()}
    assert pairs == {("a", "b"), ("a", "big"), ("b", "big")}
    assert [r["column"] for r in found["high_variance_columns"].collect()] == ["big"]
    stats = found["categorical_statistics"].first()
    assert stats["distribution_entropy"] == pytest.approx(1.0)
    assert [(m["value"], m["count"]) for m in stats["most_common"]] == [("a", 10), ("b", 10)]

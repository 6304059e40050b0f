"""One value holds a third of the rows: results against brute force, and what is shuffled."""

from collections import Counter

import pytest

from plumbline.operators import drift, filling, frequencies, measures, rules
from plumbline.sources.history import latest_per_key

ROWS = 30_000
HOT = "hot " + "x" * 100


@pytest.fixture(scope="module")
def rows():
    return [(i, HOT if i % 3 == 0 else f"w{i % 5000}", i % 7) for i in range(ROWS)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, word string, n int").repartition(6)


def test_counts(frame, rows):
    expected = Counter(word for _, word, _ in rows)
    found = {r["value"]: r["count"] for r in frequencies.value_counts(frame, ["word"]).collect()}
    assert found == expected
    top = frequencies.top_values(frame, ["word"], 3).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == sorted(expected.items(), key=lambda e: (-e[1], e[0]))[:3]
    assert frequencies.distinct_counts(frame, ["word"]).first()["distinct"] == len(expected)
    assert frame.select(filling.mode_of(frame, "word")).first()[0] == HOT
    row = rules.validate(frame, [{"expectation_type": rules.UNIQUE, "column": "word"}]).first()
    assert row["unexpected_count"] == sum(n for n in expected.values() if n > 1)


def test_groups(frame, rows):
    lowest, latest = {}, {}
    for i, word, n in rows:
        lowest.setdefault(word, (i, word, n))
        latest[word] = (i, word, n)
    assert sorted(map(tuple, filling.dedupe_rows(frame, "id", ["word"]).collect())) == sorted(lowest.values())
    assert sorted(map(tuple, latest_per_key(frame, "word", ["id"]).collect())) == sorted(latest.values())
    pairs = Counter((word, n) for _, word, n in rows)
    assert measures.duplicate_rows(frame.drop("id")).first()["duplicate_rows"] == ROWS - len(pairs)


def test_drift(frame, rows):
    before, now = frame.where("id < 20000"), frame.where("id >= 20000").replace(HOT, "cool", ["word"])
    changed = {(r["category"], r["change"]) for r in drift.drift_categories(before, now, ["word"]).collect()}
    old, new = {w for i, w, _ in rows if i < 20000}, {w.replace(HOT, "cool") for i, w, _ in rows if i >= 20000}
    assert changed == {(w, "missing") for w in old - new} | {(w, "new") for w in new - old}


def test_a_hot_value_is_shuffled_once_per_task(spark, frame):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = frequencies.kind_counts(frame.where("word like 'hot%'"), "word")
        counted.collect()
        node = counted._jdf.queryExecution().executedPlan()
        while "Exchange" not in node.nodeName():
            node = node.children().head()
        assert node.metrics().apply("shuffleRecordsWritten").value() <= 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

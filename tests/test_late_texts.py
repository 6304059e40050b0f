"""Long texts counted by key: ties and shared beginnings against brute force, also with more keys than may be broadcast."""

import random
from collections import Counter

import pytest

from plumbline.operators import drift, filling, frequencies

BEGIN = "the same beginning of more than thirty-two letters, and then "


@pytest.fixture(scope="module")
def words():
    rng = random.Random(11)
    found = [BEGIN + "x" * rng.randrange(30, 60) + rng.choice("äbc") for _ in range(400)]
    found += [rng.choice(["a", "b", BEGIN[:20], "ü" * 40, "sha2:" + "f" * 64, ""]) for _ in range(100)]
    return found + [None] * 20 + [BEGIN * 3] * 150


@pytest.fixture(scope="module")
def frame(spark, words):
    return spark.createDataFrame([(w,) for w in words], "w string").repartition(5)


@pytest.fixture(params=[frequencies.KEYS, 3, 0])
def keys(request, monkeypatch):
    """How many keys may be broadcast."""
    whole = frequencies.fetched
    for module in (frequencies, drift):
        monkeypatch.setattr(module, "fetched", lambda rows, chosen, at_most=request.param: whole(rows, chosen, min(at_most, request.param)))
    return request.param


@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_most_frequent(frame, words, keys, k):
    expected = sorted(Counter(w for w in words if w is not None).items(), key=lambda e: (-e[1], e[0].encode()))[:k]
    assert [tuple(r) for r in frequencies.most_frequent(frame, "w", k).collect()] == expected
    top = frequencies.top_values(frame, k=k).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == expected


@pytest.mark.parametrize("k", [1, 4, 12, 1000])
def test_smallest(frame, words, k):
    assert frequencies.sample_values(frame, k=k).first()["samples"] == sorted({w for w in words if w is not None}, key=str.encode)[:k]


def test_mode_and_categories(frame, words, keys):
    counts = Counter(w for w in words if w is not None)
    assert frame.select(filling.mode_of(frame, "w")).first()[0] == counts.most_common(1)[0][0]
    row = frequencies.category_statistics(frame).first()
    assert row["unique_values"] == len(counts) and row["most_common"][0]["count"] == 150


def test_changes(frame, words, keys, spark):
    now = [w for w in words[100:] if w != BEGIN * 3] + ["new " * 40, "z"]
    after = spark.createDataFrame([(w,) for w in now], "w string")
    old, new = {w for w in words if w is not None}, {w for w in now if w is not None}
    found = {(r["category"], r["change"]) for r in drift.drift_categories(frame, after).collect()}
    assert found == {(w, "missing") for w in old - new} | {(w, "new") for w in new - old}
    moved = {r["category"]: r["difference"] for r in drift.drift_distribution(frame, after, threshold=0.01).collect()}
    a, b = Counter(words), Counter(now)
    shares = {w: 100 * (b[w] / len(now) - a[w] / len(words)) for w in old & new}
    assert {w: pytest.approx(s) for w, s in shares.items() if abs(s) > 1} == moved


def test_nothing_to_show(spark):
    empty = spark.createDataFrame([], "w string")
    nulls = spark.createDataFrame([(None,)] * 3, "w string")
    for frame in (empty, nulls):
        assert frequencies.top_values(frame).count() == 0
        assert frequencies.sample_values(frame).first()["samples"] == []
        assert frequencies.category_statistics(frame).first()["unique_values"] == 0

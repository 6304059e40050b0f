"""Column states: merging is exact where it says so, bounded where it estimates, and correlations in odd cases."""

import math
import random
from collections import Counter
from datetime import date
from fractions import Fraction

import pytest

from plumbline.operators import column_states as cs
from plumbline.operators.correlation import correlations, high_correlations
from plumbline.sources import history


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # far from zero, so that sums of squares would lose the spread
    return [(1e9 + rng.gauss(0, 1), rng.choice([None, *range(5000)]), f"v{min(999, int(rng.expovariate(0.02)))}", rng.random() < 0.5) for _ in range(6000)]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "x double, n long, w string, flag boolean")


def test_merged_in_any_order(spark, rows):
    parts = [cs.column_states(frame_of(spark, part)) for part in (rows[:10], rows[10:3000], rows[3000:], [])]
    whole = cs.state_profile(cs.column_states(frame_of(spark, rows)))
    left = cs.merge_states(cs.merge_states(parts[0].union(parts[1])).union(parts[3])).union(parts[2])
    merged = {r["column"]: r for r in cs.state_profile(cs.merge_states(left)).collect()}
    for row in whole.collect():
        other = merged[row["column"]]
        for name in ("type", "rows", "nulls", "null_percentage", "min", "max"):
            assert row[name] == other[name]
        for name in ("mean", "std"):
            assert row[name] == pytest.approx(other[name], rel=1e-9) if row[name] is not None else other[name] is None
    exact = {"x": len({r[0] for r in rows}), "n": len({r[1] for r in rows} - {None}), "w": len({r[2] for r in rows}), "flag": 2}
    assert all(abs(merged[c]["unique_estimate"] - n) <= math.ceil(cs.UNIQUE_ERROR * n) for c, n in exact.items())
    xs = sorted(r[0] for r in rows)
    assert all(abs(sum(x <= merged["x"][q] for x in xs) / len(xs) - p) <= cs.RANK_ERROR for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))


@pytest.mark.parametrize("heavy", [5, 50, 5000])
def test_bounds_of_frequent_values(spark, rows, heavy):
    parts = [cs.column_states(frame_of(spark, part), ["w"], heavy) for part in (rows[:1500], rows[1500:2000], rows[2000:])]
    states = cs.merge_states(cs.merge_states(parts[0].union(parts[1]), heavy).union(parts[2]), heavy)
    counts = Counter(r[2] for r in rows)
    row = states.first()
    listed = {v["value"]: (v["count"], v["at_most"]) for v in row["heavy"]}
    assert len(listed) == min(heavy, len(counts))
    assert all(low <= counts[w] <= high for w, (low, high) in listed.items())
    assert all(n <= row["left_out"] for w, n in counts.items() if w not in listed)
    top = cs.state_top_values(states, 3).collect()
    if heavy == 5000:
        assert row["left_out"] == 0 and all(r["exact"] and r["count"] == counts[r["value"]] for r in top)


def test_days_are_replaced_and_spans_are_read(spark, rows, tmp_path):
    path = str(tmp_path / "states")
    for day, part in ((1, rows[:100]), (2, rows[100:300]), (1, rows[:50])):
        history.store_states(cs.column_states(frame_of(spark, part)), path, "d", date(2024, 1, day))
    count = lambda **span: {r["rows"] for r in history.merged_states(spark, path, "d", **span).collect()}
    assert count() == {250} and count(first=date(2024, 1, 2)) == {200} and count(last=date(2024, 1, 1)) == {50}
    assert history.merged_states(spark, path, "other").count() == 0


def test_states_of_nothing(spark):
    empty = cs.merge_states(cs.column_states(spark.createDataFrame([], "a double, b string")))
    for row in cs.state_profile(empty).collect():
        assert (row["rows"], row["unique_estimate"], row["mean"], row["std"], row["q50"]) == (0, 0, None, None, None)
    assert cs.state_top_values(empty).count() == 0


def pearson(x, y):
    """In exact fractions, as sums of doubles lose the spread of values far from zero."""
    x, y = [Fraction(v) for v in x], [Fraction(v) for v in y]
    if len(x) < 2 or len(set(x)) == 1 or len(set(y)) == 1:
        return None
    mx, my = sum(x) / len(x), sum(y) / len(y)
    together, sx, sy = (float(sum(p)) for p in zip(*[((a - mx) * (b - my), (a - mx) ** 2, (b - my) ** 2) for a, b in zip(x, y)]))
    return together / math.sqrt(sx) / math.sqrt(sy)


def test_correlations_against_brute_force(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(size=(500, 12)), columns=[f"c{i}" for i in range(12)])
    data["c1"] = data["c0"] * -2 + rng.normal(size=500) * 0.1
    data["c2"] = data["c3"] * 1e-6 + 1e9
    data = data.mask(rng.random(data.shape) < 0.3)
    data["constant"], data["c11"] = 0.1, np.nan
    frame = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in r] for r in data.to_numpy()], ", ".join(f"{c} double" for c in data)).repartition(7)
    expected = {(a, b): pearson(*[list(data[[a, b]].dropna()[c]) for c in (a, b)]) for a in data for b in data if a != b}
    found = {(r["column1"], r["column2"]): r["correlation"] for r in correlations(frame).collect()}
    assert len(found) == 13 * 13
    for a in data:
        for b in data:
            if a == b and a not in ("constant", "c11"):
                assert found[a, b] == 1.0
            elif "constant" in (a, b) or "c11" in (a, b):
                assert found[a, b] is None
            else:
                assert found[a, b] == pytest.approx(expected[a, b], abs=1e-9)
    assert {(r["column1"], r["column2"]) for r in high_correlations(frame).collect()} == {("c0", "c1"), ("c2", "c3")}
    assert correlations(frame.limit(0)).where("correlation IS NOT NULL").count() == 0

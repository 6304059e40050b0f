"""Numbers in one form, schemas as the standard has them, calls without identifiers, long chains of forward references."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import tool_calls

CALLS = "conversation long, call_id string, position long, name string, arguments string, depends_on array<string>"
RESULTS = "call_id string, position long, content string"


def linked(spark, rows, schemas, results=()):
    calls = spark.createDataFrame([(1, i, p, "f", a, d) for i, p, a, d in rows], CALLS)
    return tool_calls.link(calls, spark.createDataFrame(list(results), RESULTS), schemas).collect()


@pytest.mark.parametrize(
    "text, form",
    [
        ('{"a": 1e0, "b": [1.0, -0, 10]}', '{"a":1,"b":[1,0,10]}'),
        ('{"a": 1.50, "b": 1.5e0, "c": 15E-1}', '{"a":1.5,"b":1.5,"c":1.5}'),
        (r'{"a": "1e0 and \"2.0\"", "b": "x\\"}', r'{"a":"1e0 and \"2.0\"","b":"x\\"}'),
        ('{"a": 123456789012345678901, "b": 1e20}', '{"a":123456789012345678901,"b":100000000000000000000}'),
        ('{"z": true, "a": null}', '{"a":null,"z":true}'),
    ],
)
def test_equal_numbers_are_written_alike(spark, text, form):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tool_calls.canonical(F.to_json(F.try_parse_json("t")))).first()[0] == form


def test_integers_and_enumerations(spark):
    rules = {"i": {"type": "integer"}, "e": {"type": "number", "enum": [1, 2.5]}, "b": {"type": "boolean", "enum": [True]}, "s": {"type": "string", "enum": ["1", "true"]}}
    cases = {
        '{"i": 1.0, "e": 1.0, "b": true, "s": "1"}': [],
        '{"i": 1e0, "e": 2.50, "s": "true"}': [],
        '{"i": 123456789012345678901, "e": 1e0}': [],
        '{"i": 1.5, "e": 3, "b": false, "s": "x"}': ["b: enum", "e: enum", "i: wrong type", "s: enum"],
        '{"i": "1", "e": "1", "b": "true", "s": 1}': ["b: wrong type", "e: wrong type", "i: wrong type", "s: wrong type"],
    }
    rows = linked(spark, [(str(k), k, text, []) for k, text in enumerate(cases)], {"f": {"properties": rules}})
    assert {int(r["call_id"]): sorted(r["errors"]) for r in rows} == dict(enumerate(cases.values()))


def test_rows_without_identifiers_stay_apart(spark):
    rows = [(None, k, '{"i": 1}', ["x"]) for k in range(50)] + [("x", 1, '{"i": 1}', None), ("x", 2, '{"i": 2}', None)]
    found = linked(spark, rows, {"f": {"properties": {}}}, [(None, 1, "lost"), (None, 2, "lost too"), ("x", 5, "here"), ("y", 1, "nobody's")])
    counts = {}
    for r in found:
        key = (r["call_id"], r["status"], r["n_results"])
        counts[key] = counts.get(key, 0) + 1
    assert counts == {(None, "unanswered", 0): 50, ("x", "linked", 1): 2, (None, "orphan", 2): 1, ("y", "orphan", 1): 1}
    assert all((r["major"], r["minor"]) == (k, 0) for k, r in enumerate(sorted((r for r in found if r["call_id"] is None and r["valid"] is not None), key=lambda r: r["major"])))


def test_order_along_forward_references(spark):
    """Call k refers to call k + 1: the last comes first. Two more make a cycle, and one waits for it."""
    n = 11
    rows = [(f"c{k}", k, '{"i": 1}', [f"c{k + 1}"] if k + 1 < n else []) for k in range(n)]
    rows += [("p", 1, "{}", ["q"]), ("q", 2, "{}", ["p"]), ("r", 3, "{}", ["q", "c0"])]
    found = {r["call_id"]: r for r in linked(spark, rows, {"f": {"properties": {}}})}
    assert [(found[f"c{k}"]["major"], found[f"c{k}"]["minor"]) for k in range(n)] == [(n - 1, n - 1 - k) for k in range(n)]
    assert all(found[c]["major"] is None and found[c]["errors"] == ["cyclic references"] for c in "pqr")

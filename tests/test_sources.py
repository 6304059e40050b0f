import json
import uuid
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from plumbline.operators import filling, nested
from plumbline.operators.column_types import json_rows, narrow_dates, rename_spaces
from plumbline.operators.measures import null_profile, table_shape
from plumbline.plans.source_report import analyze_file, analyze_table
from plumbline.session import scratch_dir, scratch_path, stage
from plumbline.sources import files, history, reports, rulesets, tables

# Rows of the kind the cleaning rules are for: mixed case, doubled blanks, gaps, a word among numbers.
PRODUCTS = '''id,product name,kind,price,stock,rating
1,Desk   Lamp,LIGHT,10.5,4,4.5
2,desk lamp,light,10.5,4,4.5
3,"Chair, ""blue""",Seat,,NULL,3
,Stool,SEAT,20,-5,bad
5,,seat,30,7,
'''


@pytest.fixture(scope="module")
def products(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "products.csv"
    path.write_text(PRODUCTS)
    return files.scan_csv(spark, str(path))


def test_csv_types_and_null_tokens(products):
    assert dict(products.dtypes) == {
        "id": "bigint",
        "product name": "string",
        "kind": "string",
        "price": "double",
        "stock": "bigint",
        "rating": "string",
    }
    rows = [r.asDict() for r in products.collect()]
    assert rows[2] == {"id": 3, "product name": 'Chair, "blue"', "kind": "Seat", "price": None, "stock": None, "rating": "3"}
    assert rows[3]["id"] is None and rows[4]["product name"] is None and rows[4]["rating"] is None


def test_csv_with_a_schema_and_line_breaks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b,c\n1,"two\nlines",x\n2,y,4\n')
    frame = files.scan_csv(spark, str(path), "a int, b string, c double", multi_line=True)
    assert [tuple(r) for r in frame.collect()] == [(1, "two\nlines", None), (2, "y", 4.0)]


def test_csv_booleans_big_numbers_and_nothing(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c,d\nTrue,99999999999999999999,,007\nfalse,1,NaN,8\n")
    frame = files.scan_csv(spark, str(path))
    assert dict(frame.dtypes) == {"a": "boolean", "b": "double", "c": "double", "d": "bigint"}
    assert [tuple(r) for r in frame.collect()] == [(True, 1e20, None, 7), (False, 1.0, None, 8)]


def test_csv_rows_of_another_width(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n")
    assert [tuple(r) for r in files.scan_csv(spark, str(path)).collect()] == [(1, 2, 3), (4, 5, None)]
    path.write_text("a,b,c\n1,2,3\n4,5,6,7\n")
    with pytest.raises(Exception, match="more cells than columns: 4,5,6,7"):
        files.scan_csv(spark, str(path)).collect()


def test_cleaning_in_steps(products):
    clean = filling.clean_texts(rename_spaces(products))
    typed = clean.withColumn("rating", F.col("rating").try_cast("double"))
    kept = filling.dedupe_rows(typed, "id")
    # rows 1 and 2 agree on all but the id
    assert kept.count() == 4 and {r["id"] for r in kept.collect()} == {1, 3, None, 5}
    filled = {r["id"]: r for r in filling.clip_range(filling.impute_mean(kept, ["price", "stock", "rating"]), "stock", 0).collect()}
    assert filled[3]["price"] == pytest.approx((10.5 + 20 + 30) / 3)
    assert filled[3]["stock"] == pytest.approx((4 - 5 + 7) / 3) and filled[None]["stock"] == 0
    assert filled[5]["rating"] == pytest.approx((4.5 + 3) / 2)
    named = {r["id"]: r for r in filling.impute_mode(kept, ["product_name"]).collect()}
    assert named[5]["product_name"] == 'chair, "blue"'


def test_dedupe_prefers_an_id(spark):
    frame = spark.createDataFrame([(None, "a", 1), (4, "a", 2), (3, "a", 3), (None, "b", 4)], "id int, k string, v int")
    kept = sorted(filling.dedupe_rows(frame, "id", ["k"]).collect(), key=lambda r: r["k"])
    assert [tuple(r) for r in kept] == [(3, "a", 3), (None, "b", 4)]


@pytest.mark.parametrize("layout", ["document", "one line", "one object", "lines"])
def test_json_layouts(spark, tmp_path, layout):
    records = [{"a": 1, "b": {"c": {"d": "x"}, "l": [1, 2]}}, {"a": 2, "b": {"c": {"d": "y"}, "l": []}}]
    text = {
        "document": json.dumps(records, indent=2),
        "one line": json.dumps(records),
        "one object": json.dumps(records[0], indent=1),
        "lines": "\n".join(map(json.dumps, records)),
    }[layout]
    path = tmp_path / "x.json"
    path.write_text(text)
    frame = files.scan_json(spark, str(path))
    assert frame.columns == ["a", "b_c_d", "b_l"]
    assert frame.count() == (1 if layout == "one object" else 2)
    assert frame.orderBy("a").first()["b_c_d"] == "x"
    typed = files.scan_json(spark, str(path), "a int, b struct<c: struct<d: string>>")
    assert sorted(tuple(r) for r in typed.collect()) == [(1, "x"), (2, "y")][: frame.count()]


def test_broken_json_lines_are_no_document(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('\n{"a": 1}\n{"a": 2\n{"a": 3}\n')
    with pytest.raises(ValueError, match="some lines are not JSON"):
        files.scan_json(spark, str(path))


def test_jsonl_stops_at_a_bad_line(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_jsonl(spark, str(path), "a int").collect()


def test_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("12345")
    (row,) = files.file_inventory(spark, str(tmp_path)).collect()
    assert (row["name"], row["size"], row["modified"].year >= 2024) == ("a.csv", 5, True)


def test_tables(spark, tmp_path):
    schema, frame = f"s_{uuid.uuid4().hex}", spark.createDataFrame([(1, "x")], "`a b` int, c string")
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{tmp_path / 's'}'")
    tables.write_table(rename_spaces(frame), "t", "fail", schema)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        tables.write_table(rename_spaces(frame), "t", "fail", schema)
    tables.write_table(rename_spaces(frame), "t", "append", schema)
    assert tables.read_table(spark, "t", schema).count() == 2
    assert [(r["schema"], r["table"]) for r in tables.list_tables(spark, schema).collect()] == [(schema, "t")]
    assert (schema, "t") in [(r["schema"], r["table"]) for r in tables.list_tables(spark).collect()]
    assert [tuple(r) for r in tables.table_info(frame).orderBy("position").collect()] == [(1, "a b", "int", True), (2, "c", "string", True)]
    with pytest.raises(ValueError, match="if_exists"):
        tables.write_table(frame, "t", "maybe")


@pytest.mark.parametrize("broadcast_rows", [tables.BROADCAST_ROWS, 0])
def test_ingest_with_row_numbers(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", broadcast_rows)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text("a,b\n" + "".join(f"{i * 1000 + k},{'x' * 50}\n" for k in range(1000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
        name = f"numbered_{uuid.uuid4().hex}"
        tables.ingest_csv(spark, str(folder), name, path=str(tmp_path / "t"), index=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    rows = tables.read_table(spark, name).select("index", "a").collect()
    assert sorted((r["index"], r["a"]) for r in rows) == [(i, i) for i in range(3000)]


def test_report_round_trip(spark, tmp_path):
    frame = spark.sql(
        "select 1 as n, double('NaN') as x, timestamp_ntz'2024-01-02 03:04:05' as a, timestamp_ntz'2024-01-02 03:04:05.5' as b,"
        " date'2024-01-02' as d, array(1) as l, named_struct('k', 'v') as s"
    )
    assert json.loads(json_rows(frame).first()[0]) == {
        "n": 1,
        "x": None,
        "a": "2024-01-02T03:04:05",
        "b": "2024-01-02T03:04:05.500000",
        "d": "2024-01-02",
        "l": [1],
        "s": {"k": "v"},
    }
    reports.write_report(frame, str(tmp_path / "r"))
    assert reports.read_report(spark, str(tmp_path / "r")).first()["b"] == "2024-01-02T03:04:05.500000"


def test_history_keeps_all_and_finds_the_latest(spark, tmp_path, products):
    path, summary, columns = str(tmp_path / "p"), table_shape(products).select("rows"), null_profile(products)
    ids = [history.store_profile(summary, columns, path, "shop", datetime(2024, m, 1, tzinfo=timezone.utc)) for m in (1, 3, 2)]
    history.store_profile(summary, columns, path, "other")
    assert history.read_profiles(spark, path).count() == 4
    latest = history.latest_profile(spark, path, "shop").first()
    assert latest["id"] == ids[1] and json.loads(latest["summary"]) == [{"rows": 5}]
    assert {c["column"]: c["null_count"] for c in json.loads(latest["column_profiles"])}["price"] == 1
    assert history.latest_profile(spark, path, "nobody").count() == 0
    changes = spark.createDataFrame([("kind", "x", "new"), ("kind", "y", "new"), ("kind", "z", "missing")], "column string, category string, change string")
    at = str(tmp_path / "a")
    older = history.store_anomalies(summary, columns, changes.limit(0), at, "shop", date(2024, 1, 1))
    newer = history.store_anomalies(summary, columns, changes, at, "shop", date(2024, 1, 2))
    latest = history.latest_anomalies(spark, at, "shop").first()
    assert latest["id"] == newer and latest["comparison_date"] == date(2024, 1, 2)
    assert json.loads(latest["new_values"]) == [{"column": "kind", "values": 2}]
    assert json.loads(latest["missing_values"]) == [{"column": "kind", "values": 1}]
    assert sorted(history.anomaly_values(spark, at, "shop", newer).collect()) == sorted(changes.collect())
    assert history.anomaly_values(spark, at, "shop", older).count() == 0


def test_rule_sets(spark, tmp_path):
    listed = [{"expectation_type": "expect_column_values_to_not_be_null", "column": "x", "rule_id": "r"}]
    rulesets.save_rules(spark, listed, str(tmp_path / "f"))
    (rule,) = rulesets.load_rules(spark, str(tmp_path / "f"))
    assert (rule.rule_id, rule.kwargs) == ("r", {"column": "x"})
    first = rulesets.store_rules(spark, listed, str(tmp_path / "t"), "first", "about x")
    second = rulesets.store_rules(spark, [], str(tmp_path / "t"), "second")
    assert [r["id"] for r in rulesets.list_rule_sets(spark, str(tmp_path / "t")).collect()] == [second, first]
    assert rulesets.stored_rules(spark, str(tmp_path / "t"), first) == [rule]
    assert rulesets.stored_rules(spark, str(tmp_path / "t"), "nothing") == []
    assert rulesets.rules_frame(spark, [rule]).first()["kwargs"] == '{"column": "x"}'


def test_flatten(spark):
    frame = spark.sql(
        "select 1 as id, named_struct('a', 1, 'b', named_struct('c', 2)) as s, array(named_struct('k', 'x'), named_struct('k', 'y')) as objects,"
        " array(5, 6) as plain, cast(null as array<int>) as none"
    )
    flat = nested.flatten(frame)
    assert flat.columns == ["id", "s_a", "s_b_c", "objects_k", "plain_length", "plain_items", "none_length", "none_items"]
    assert tuple(flat.first()) == (1, 1, 2, ["x", "y"], 2, [5, 6], None, None)
    assert nested.flatten(frame, ["s"]).columns == ["id", "s_a", "s_b_c", "objects", "plain", "none"]
    with pytest.raises(ValueError, match="two columns named s_a"):
        nested.flatten(frame.withColumn("s_a", F.lit(1)))


def test_flatten_json_text(spark):
    texts = ['{"a": 1, "b c": {"d": 1.5}, "l": [1, 2], "n": null}', '{"a": 2, "e": "x"}', "plain", "7", None, "{broken"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    flat = nested.flatten_json_text(frame, "j").orderBy("i")
    assert set(flat.columns) == {"i", "j_value", "j_a", "j_b c_d", "j_l_length", "j_l_items", "j_n", "j_e"}
    rows = [r.asDict() for r in flat.collect()]
    assert [r["j_a"] for r in rows] == [1, 2, None, None, None, None]
    assert [r["j_value"] for r in rows] == [None, None, "plain", "7", None, "{broken"]
    assert rows[0]["j_b c_d"] == 1.5 and rows[0]["j_l_length"] == 2 and rows[1]["j_e"] == "x"
    objects = spark.createDataFrame([('[{"k": 1}, {"k": 2}]',), ("[]",)], "j string")
    assert [r["j_k"] for r in nested.flatten_json_text(objects, "j").collect()] == [[1, 2], []]
    mixed = nested.flatten_json_text(spark.createDataFrame([('{"a": 1}',), ("[1]",)], "j string"), "j")
    assert {(r["j_a"], r["j_length"]) for r in mixed.collect()} == {(1, None), (None, 1)}
    plain = spark.createDataFrame([("x",)], "j string")
    assert nested.flatten_json_text(plain, "j").columns == ["j"]


def test_dates_are_narrowed(spark):
    frame = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as day, timestamp_ntz'2024-01-01 00:00:01' as time")
    assert dict(narrow_dates(frame).dtypes) == {"day": "date", "time": "timestamp_ntz"}


def test_scratch(spark):
    assert scratch_dir(spark) == scratch_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    frame = spark.range(5).withColumn("y", F.col("id") * 2)
    staged = stage(frame)
    assert sorted(staged.collect()) == sorted(frame.collect()) and staged.schema.names == frame.schema.names


def test_reports_on_a_file_and_a_table(spark, tmp_path, products):
    path = tmp_path / "products.csv"
    path.write_text(PRODUCTS)
    listed = {"expectations": [{"expectation_type": "expect_column_values_to_not_be_null", "column": "product name"}]}
    report = analyze_file(spark, str(path), listed, str(tmp_path / "out"))
    assert report["rules"].first()["column"] == "product_name" and report["rules"].first()["unexpected_count"] == 1
    written = reports.read_report(spark, str(tmp_path / "out" / "metrics"))
    assert {r["column"]: r["null_count"] for r in written.collect()}["price"] == 1
    assert {r["issue_type"] for r in reports.read_report(spark, str(tmp_path / "out" / "issues")).collect()} >= {"inconsistent_casing"}
    name = f"products_{uuid.uuid4().hex}"
    tables.write_table(rename_spaces(products), name, path=str(tmp_path / "t"))
    of_table = analyze_table(spark, name)
    assert of_table["metadata"].count() == 6 and of_table["value_counts"].where("column = 'kind'").count() == 5
    with pytest.raises(ValueError, match="xlsx"):
        files.scan_file(spark, "x.xlsx")

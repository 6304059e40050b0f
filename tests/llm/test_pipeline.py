"""Every stage of the pipeline against a brute-force set of rows, from that stage's own input."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from compare import connect

import corpus_pipeline
from plumbline.llm import queries, toxicity
from plumbline.session import scratch_path

sys.path.append(str(Path(__file__).parent))
from test_queries import brute_components, brute_prints  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [f"{sf_dir}/documents.parquet"]
    for name, function in corpus_pipeline.STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        made.append(path)
    return made


def ids(spark, path):
    return Counter(r["doc_id"] for r in spark.read.parquet(path).select("doc_id").collect())


def by_sql(sf_dir, path, sql):
    con = connect(sf_dir)
    source = path if path.endswith("documents.parquet") else f"{path}/*.parquet"
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{source}'")
    return con.sql(sql).to_arrow_table().to_pylist()


def test_quality(spark, sf_dir, stages):
    assert ids(spark, stages[1]) == Counter(r["doc_id"] for r in by_sql(sf_dir, stages[0], queries.RULES_SQL) if r["kept"])


def test_toxicity(spark, sf_dir, stages):
    docs = spark.read.parquet(stages[1])
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", "text").collect()
    assert ids(spark, stages[2]) == Counter(r["doc_id"] for r in rows if scorer.score(r["text"]) < 0.5)
    assert sum(ids(spark, stages[2]).values()) < len(rows)


def test_near_duplicates(spark, stages):
    rows = spark.read.parquet(stages[2]).select("doc_id", "text").collect()
    roots = brute_components([r["doc_id"] for r in rows], brute_prints([r["text"] for r in rows]))
    assert ids(spark, stages[3]) == Counter(set(roots)) and len(set(roots)) < len(rows)


def test_decontamination(spark, sf_dir, stages):
    found = by_sql(sf_dir, stages[3], queries.LEAKS_SQL)
    assert ids(spark, stages[4]) == Counter(r["doc_id"] for r in found if not r["contaminated"]) and any(r["contaminated"] for r in found)


def test_mixing(spark, sf_dir, stages):
    expected = {r["doc_id"]: r["taken"] // r["size"] for r in by_sql(sf_dir, stages[4], queries.MIXING_SQL) if r["taken"]}
    assert ids(spark, stages[5]) == Counter(expected)
    copies = Counter((r["doc_id"], r["copy"]) for r in spark.read.parquet(stages[5]).collect())
    assert copies == Counter((i, k) for i, n in expected.items() for k in range(1, n + 1))


def test_texts_and_columns_stay_as_they_are(spark, stages):
    given = {r["doc_id"]: tuple(r) for r in spark.read.parquet(stages[0]).collect()}
    names = spark.read.parquet(stages[0]).columns
    for path in stages[1:]:
        kept = spark.read.parquet(path)
        assert all(given[r["doc_id"]] == tuple(r) for r in kept.select(*names).collect())
        assert kept.columns == names or path == stages[-1]

"""A corpus from documents to a training mix, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last
return the columns of the documents they were given, whatever else these hold; the last adds the number
of the copy. Null texts fail the quality rules. Empty tables pass through all stages.

Texts are taken whole, however long. The first two stages and the fourth decide each row by its text, so equal rows share
their fate, whatever their ids. The third leaves one of them, rows being told apart by a number. The last draws a coin for
each row, also for equal ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, mixing, near_duplicates, quality_rules, toxicity
from plumbline.llm.common import small
from plumbline.session import stage as staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(docs: DataFrame) -> DataFrame:
    """The text, and all columns of a document as one, so that added columns can't clash with them."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), docs["text"].alias("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.apply_rules(_whole(docs), keep=["document"]).where("kept").select("document.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str, cut: float = 0.5) -> DataFrame:
    """Documents that are more likely not toxic. The model is fitted on all labels of the documents given."""
    scorer = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(_whole(docs), scorer).where(F.col("score") < cut).select("document.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """``document, row_no``, staged: rows are told apart by the number, as ids may be null or repeated."""
    document = F.struct(*[docs[c] for c in docs.columns]).alias("document")
    return staged(docs.select(document, F.monotonically_increasing_id().alias("row_no")), "rows")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose numbers are not in ``gone``. These are the fewer, and texts need not be shuffled
    where they can be broadcast."""
    return rows.join(small(staged(gone.select("row_no"), "gone")), "row_no", "left_anti").select("document.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least id, null ids last; of equal ids the first."""
    rows = _numbered(docs)
    key = F.struct(F.col("document.doc_id").isNull().alias("unnamed"), F.col("document.doc_id").alias("doc_id"), "row_no")
    found = near_duplicates.near_duplicates(rows.select(key.alias("key"), F.col("document.text").alias("text")), id="key")
    return _without(rows, found.where("id.row_no <> component_id.row_no").select("id.row_no"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    rows = _numbered(docs)
    found = decontamination.contamination(rows.select("row_no", F.col("document.text").alias("text")), _table(spark, sf_dir, "benchmark"), id="row_no")
    return _without(rows, found.where("n_hit > 0").select(F.col("id").alias("row_no")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of the copy."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("near duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: SimHash and the toxicity model are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder for the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = staged(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

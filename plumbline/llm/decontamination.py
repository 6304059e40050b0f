"""Benchmark decontamination with a positional inverted index, as joins and groupings of Spark.

The index holds a posting (text, term, position) for every training token whose term some test phrase
has; it is made in one pass over the texts and written to the shared folder. A phrase is then looked up
from its rarest terms: postings of the rarest give candidate starts (position less the term's offset),
the second rarest term's offset-adjusted list cuts them down, and those of all other terms, read only for
the texts still in question, must agree. With ``slop`` positions may be off by so much: a proximity match.

A phrase that very many texts share is one phrase here, and its postings are spread by text before any
grouping. Phrases and their terms are broadcast if a count shows that they are few; else Spark shuffles.

Null texts have no words. Rows are told apart by a number given while indexing, so repeated or null ids
mix nothing up, and repeated rows are looked at each. Texts of any length are taken whole. Null or empty items make no
phrase; items with the same words share one. An item without an id marks the words of its windows as hit, but has no name to
be listed or counted under. Without documents or without items the results are empty, or clean. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, small
from plumbline.session import stage

WINDOW = 10
#: What stands between words: ASCII other than letters and digits. Upper case counts as lower.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def phrases(items: DataFrame, id: str = "item_id", text: str = "text", length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(``phrase, terms``: the different windows, ``phrase, item``: whose they are).

    A text of fewer words, but not none, is one window.
    """
    split = items.select(items[id].alias("item"), words(ascii_lower(items[text])).alias("terms")).where(F.size("terms") > 0)
    cut = F.expr(f"transform(sequence(1, greatest(1, size(terms) - {length - 1})), i -> slice(terms, i, {length}))")
    windows = split.select("item", F.explode(cut).alias("terms"))
    known = stage(windows.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    return known, stage(windows.join(known, "terms").select("phrase", "item").distinct(), "items")


def vocabulary(known: DataFrame) -> DataFrame:
    """``term, word`` for every word of a phrase."""
    distinct = known.select(F.explode("terms").alias("word")).distinct()
    return stage(distinct.withColumn("term", F.monotonically_increasing_id()), "terms")


def build_index(docs: DataFrame, terms: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``text_no, id, term, position``: a posting for every token with a known term, and one row for each
    text, without a term, whose position is the number of its words."""
    rows = docs.select(F.monotonically_increasing_id().alias("text_no"), docs[id].alias("id"), words(docs[text]).alias("words"))
    # no word is empty, so the empty word after the last stands for the text
    tokens = rows.select("text_no", "id", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("position", "token"))
    # lower() is fast on ASCII but lowers other letters too: a first match, made exact after the join
    keys = terms.select("term", "word", F.lower("word").alias("key")).unionByName(
        terms.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("term"), F.lit("").alias("word"), F.lit("").alias("key"))
    )
    found = tokens.join(small(keys), F.lower("token") == F.col("key")).where(ascii_lower(F.col("token")) == F.col("word"))
    return stage(found.select("text_no", F.when(F.col("term").isNull(), F.col("id")).alias("id"), "term", "position"), "postings")


def lists(known: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """``phrase, lists``: the (frequency, offset, term) of each phrase, rarest first, for phrases all of
    whose terms occur."""
    counts = index.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("n"))
    counted = terms.join(counts, "term").select("word", "term", "n")
    spread = known.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "word"))
    per = spread.join(counted, "word").groupBy("phrase", "length").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("lists"))
    return stage(per.where(F.size("lists") == F.col("length")).select("phrase", "length", "lists"), "lists")


def _agree(candidates: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """Of candidates (``phrase, length, text_no, start, list``) those with a posting near start + offset."""
    width = 2 * slop + 1
    at = F.col("start") + F.col("list.offset")
    sought = candidates.withColumns({"term": F.col("list.term"), "at": at})
    cells = F.array_distinct(F.array(F.floor((F.col("at") - slop) / width), F.floor((F.col("at") + slop) / width)))
    sought = sought.withColumn("cell", F.explode(cells)).drop("list")
    postings = index.select("text_no", "term", "position", F.floor(F.col("position") / width).alias("cell"))
    return sought.join(postings, ["text_no", "term", "cell"]).where(F.abs(F.col("position") - F.col("at")) <= slop)


def matches(index: DataFrame, looked_up: DataFrame, slop: int = 0) -> DataFrame:
    """``phrase, text_no, start, length``: where phrases occur, exactly or with every term at most ``slop``
    words from its place after the rarest term's.

    ``index`` and ``looked_up`` come from ``build_index`` and ``lists``.
    """
    postings = index.where(F.col("term").isNotNull()).select("text_no", "term", "position")
    rarest = small(looked_up.withColumn("term", F.col("lists")[0]["term"]))
    starts = postings.join(rarest, "term").withColumn("start", F.col("position") - F.col("lists")[0]["offset"])
    starts = starts.select("phrase", "length", "lists", "text_no", "start")
    if slop == 0:
        starts = starts.where("start >= 0")
    single = starts.where("length = 1").select("phrase", "text_no", "start", "length")
    second = looked_up.where("length > 1").select(F.col("lists")[1]["term"].alias("term")).distinct()
    some = postings.join(small(second), "term", "left_semi")
    pairs = _agree(starts.where("length > 1").withColumn("list", F.col("lists")[1]), some, slop)
    pairs = stage(pairs.select("phrase", "length", "lists", "text_no", "start").distinct(), "pairs")
    rest = pairs.select("phrase", "length", "text_no", "start", F.explode(F.expr("slice(lists, 3, length)")).alias("list"))
    near = postings.join(small(pairs.select("text_no").distinct()), "text_no", "left_semi")
    agreed = _agree(rest.withColumn("offset", F.col("list.offset")), near, slop)
    agreed = agreed.groupBy("phrase", "length", "text_no", "start").agg(F.count_distinct("offset").alias("n")).where("n = length - 2")
    two = pairs.where("length = 2").select("phrase", "text_no", "start", "length")
    return single.unionByName(two).unionByName(agreed.select("phrase", "text_no", "start", "length"))


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = WINDOW) -> DataFrame:
    """``id, n_words, n_hit, items``: for every document, its words, those within an occurrence of a
    window, and the sorted ids, as strings, of the items that occur."""
    known, owners = phrases(items, item, item_text, length)
    terms = vocabulary(known)
    index = build_index(docs, terms, id, text)
    found = stage(matches(index, lists(known, terms, index)), "matches")
    hit = found.select("text_no", F.explode(F.expr("sequence(start, start + length - 1)")).alias("position")).distinct()
    hit = hit.groupBy("text_no").agg(F.count("*").alias("n_hit"))
    whose = found.select("phrase", "text_no").distinct().join(small(owners), "phrase").select("text_no", F.col("item").cast("string").alias("item")).distinct()
    whose = whose.groupBy("text_no").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = index.where(F.col("term").isNull()).select("text_no", "id", F.col("position").cast("long").alias("n_words"))
    joined = rows.join(hit, "text_no", "left").join(whose, "text_no", "left")
    return joined.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

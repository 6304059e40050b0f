"""The toxicity model learns from every labelled row, however many there are."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import toxicity
from plumbline.llm.common import remainder

RARE = "grobian"


@pytest.fixture(scope="module")
def many(spark):
    """18,000 clean and 1,500 toxic rows; four of the toxic ones hold a word that no other row has."""
    rng = random.Random(8)
    words = ["".join(rng.sample("abdeiklmnorstu", 7)) for _ in range(300)]
    rows = []
    for i in range(19_500):
        text = [rng.choice(words) for _ in range(12)]
        if i >= 18_000:
            text[3] = RARE if i < 18_004 else "idiot"
        rows.append((i, " ".join(text), int(i >= 18_000)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return table.select("doc_id", "text"), table.select("doc_id", "toxic")


def training(docs, labels):
    return docs.join(labels, "doc_id").where(remainder(docs["doc_id"], 2) != 0).toPandas()


def test_all_labelled_rows_are_counted(many):
    docs, labels = many
    rows = training(docs, labels)
    model = toxicity.fit(docs, labels, folds=2)
    # every different row teaches: none is a near copy of another
    letters, starts = Counter(), Counter()
    for text in rows["text"]:
        for word in text.split():
            letters.update(word + " ")
            starts[word[:2]] += 1
    counts = model.restorer.model.counts
    assert {k: n for k, n in counts.items() if len(k) == 1} == letters and rows["toxic"].eq(0).sum() > 6000
    assert all(counts[" " + start] == n for start, n in starts.items() if n > 2)
    n0, n1 = (int(rows["toxic"].eq(c).sum()) for c in (0, 1))
    a = int((rows["text"].str.contains("idiot")).sum())
    assert model.weights["idiot$"] == pytest.approx(math.log((a + 0.5) / (n1 + 1)) - math.log(0.5 / (n0 + 1)))
    # the regression is at its optimum over all rows: there the gradient is none
    x = np.array([model.evidence(text) for text in rows["text"]])
    w = np.array(model.coefficients)
    assert x.T @ (1 / (1 + np.exp(-x @ w)) - rows["toxic"].to_numpy()) + 0.01 * w == pytest.approx(np.zeros(4), abs=1e-5)


def test_different_texts_with_an_equal_run_of_words_all_teach(spark):
    rng = random.Random(9)
    line = "all rights reserved by"
    rows = [(i, f"{line} " + " ".join(f"w{rng.randrange(10**6):06}" for _ in range(6)), i % 2) for i in range(400)]
    rows += [(1000 + i, "one and the same text in many rows of the table", 0) for i in range(40)]
    rows += [(2000 + i, "a longer text that is copied with a little edit at the very end of it here " * 3 + f"end{i}", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = set(r["doc_id"] for r in df.where(remainder(df["doc_id"], 5) == 0).collect())
    taught = toxicity._sample(df.select("doc_id", "text"), df, "doc_id", "text", "toxic", 5).toPandas()
    expected = [t for i, t, _ in rows if i not in held]
    assert sorted(taught["text"]) == sorted(expected)
    weight = taught.set_index("text")["weight"]
    assert all(weight[t] == 1 for i, t, _ in rows if i < 1000 and i not in held)
    for label, first in ((0, "one and"), (1, "a longer")):
        copies = taught[taught["text"].str.startswith(first)]
        # an edit may hold the smallest and the largest hash of its text
        assert len(copies) > 15 and set(copies["label"]) == {label} and 0.999 < copies["weight"].sum() < 4


def test_different_words_are_those_of_the_text():
    rng = random.Random(10)
    restorer = toxicity.Restorer(toxicity.Characters({"a": 5, " a": 3, "b": 4, "ab": 2, "c": 1}))
    signs = [*"abc5@-!$.|", *" " * 9, "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert restorer.different(text) == set(restorer.words(text))


def test_the_words_that_weigh_are_found_among_all_tokens():
    rng = random.Random(12)
    restorer = toxicity.Restorer(toxicity.Characters({"i": 5, "d": 3, "o": 4, "t": 4, " id": 2, "idi": 2}))
    scorer = toxicity.Scorer(restorer, {"idi": 2.0, "idio$": 1.0, "ab$": 0.5, "x$": 0.4, "$$": 0.3, "low": -1.0}, [0.0, 1.0, 1.0, 1.0])
    tokens = ["idiot", "1d10t!", "idio", "ab", "abc", "ab.", "x", "$", "lowly", "plain", "i d i o t s", "(ab)", "5", ""]
    for _ in range(300):
        text = " ".join(rng.choice(tokens) for _ in range(rng.randrange(9)))
        found = sorted((x for x in map(scorer.weight, set(restorer.words(text))) if x > 0), reverse=True)
        assert scorer.evidence(text) == [1.0, *(found + [0.0, 0.0])[:2], math.log1p(len(found))]

def test_the_pipeline_learns_from_all_clean_documents(spark, tmp_path):
    """Four toxic rows with a word are too few beside 6,000 clean ones, and enough beside 14,000."""
    rng = random.Random(13)
    words = ["".join(rng.sample("abdeiklmnorstu", 7)) for _ in range(300)]
    taught = [i for i in range(30_000) if zlib.crc32(str(i).encode()) % 5][:15_500]
    rows = []
    for place, i in enumerate(taught):
        text = [rng.choice(words) for _ in range(12)]
        if place >= 14_300:
            text[3] = RARE if place < 14_304 else "idiot"
        rows.append((i, " ".join(text), int(place >= 14_300)))
    unknown = [(40_000, f"{rows[0][1]} {RARE}"), (40_001, f"{rows[1][1]} idiot"), (40_002, f"{rows[2][1]} {words[0]}")]
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([r[:2] for r in rows] + unknown, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.clean(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert kept == {i for i, _, y in rows if y == 0} | {40_002}

"""Rows without ids, or with the same one: draws and coins by row; whole runs of letters; fingerprints with an equal half."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id, mixing, near_duplicates, toxicity

FRENCH = "la maison et le chat dans les rues avec une autre que nous sommes pour cette histoire vous êtes".split()
ENGLISH = "the house and a cat in these streets with another that we are for this story you were".split()


def sentence(rng, words):
    return " ".join(rng.choice(words) for _ in range(12))


def test_a_language_without_ids_is_learned(spark):
    rng = random.Random(1)
    rows = [(None, sentence(rng, FRENCH), "fr") for _ in range(1500)] + [(i, sentence(rng, ENGLISH), "en") for i in range(1500)]
    # all rows of a language may even be the same
    rows += [(None, "gleich gleich und nochmals gleich", "de")] * 1500
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_language=100)
    both = found.select("lang_pred", F.col("id").isNull().alias("unnamed")).groupBy("lang_pred", "unnamed").count().collect()
    assert {(r["lang_pred"], r["unnamed"]): r["count"] for r in both} == {("fr", True): 1500, ("en", False): 1500, ("de", True): 1500}


def test_numbers_that_are_no_digits_part_words():
    assert language_id.runs("m² x² Ⅷab Straße 12a ½") == ["m", "x", "ab", "straße", "a"]


@pytest.fixture(scope="module")
def lattice():
    lattice = language_id.Lattice(["a", "b", "ab", "ba", "aab", "▁", "▁a", "abab"])
    p = np.random.default_rng(1).random((lattice.size, 2))
    p[0] = 0
    return lattice, p / p.sum(axis=0)


def test_cuts_of_long_runs_are_all_summed(lattice):
    lattice, p = lattice
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 31, 32, 33, 63, 64, 65, 100, 300, 300, 2000)]
    for word, found in zip(words, lattice.log_probabilities(words, p)):
        for j in range(2):
            marked, total = "▁" + word, [Fraction(1)] + [Fraction(0)] * (len(word) + 1)
            for end in range(1, len(marked) + 1):
                for k in range(1, min(lattice.longest, end) + 1):
                    piece = int(lattice.ids.get(marked[end - k : end], k == 1))
                    total[end] += total[end - k] * Fraction(float(p[piece, j])) if piece else 0
            exact = math.log(total[-1].numerator) - math.log(total[-1].denominator)
            assert found[j] == pytest.approx(exact, rel=1e-9)


def test_expected_pieces_by_listing_all_cuts(lattice):
    lattice, p = lattice

    def cuts(word):
        if not word:
            yield []
        for k in range(1, min(lattice.longest, len(word)) + 1):
            piece = int(lattice.ids.get(word[:k], k == 1))
            for rest in cuts(word[k:]) if piece else ():
                yield [piece, *rest]

    for word in ("a", "abab", "aabab", "cabac", "babaabab"):
        counts, total = np.zeros(lattice.size), 0.0
        for cut in cuts("▁" + word):
            weight = np.prod(p[cut, 0])
            total += weight
            np.add.at(counts, cut, weight)
        assert lattice.expected([word], np.array([3.0]), p[:, 0]) == pytest.approx(3 * counts / total)
    lengths = np.array([0, 1, *map(len, list(lattice.ids))])
    assert lattice.expected(["ab" * 400], np.array([1.0]), p[:, 0]) @ lengths == pytest.approx(801)


def test_the_labelled_sample_counts_rows(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnop"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(9)) for _ in range(6000)]
    rows = [(1, t) for t in texts[:5000]] + [(i, t) for i, t in enumerate(texts[5000:], 10)] + [(1, texts[0])] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), *[(i, 0) for i in range(10, 1010)]], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, "doc_id", "text", "toxic", 5, 50).toPandas()
    per = sample["label"].value_counts()
    assert sample["text"].is_unique and all(20 <= n <= 90 for n in per)


@pytest.mark.parametrize("kind", ["without ids", "one id", "equal rows"])
def test_targets_are_met_without_ids(spark, kind):
    rng = random.Random(4)
    if kind == "equal rows":
        rows = [(7, "w " * 10, s) for s in "abc" for _ in range(1500)]
    else:
        rows = [(None if kind == "without ids" else 5, f"{i} " + "w " * rng.randrange(5, 25), s) for s in "abc" for i in range(1500)]
    drawn = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    per = drawn.groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 3 and all(abs(r["taken"] - r["target"]) <= 0.05 * r["target"] for r in per)


def test_a_column_called_copy_stays(spark):
    df = spark.createDataFrame([(1, "a b", "s", 7)], "doc_id long, text string, source string, copy int")
    rows = mixing.mix(df).collect()
    assert rows and {r["copy"] for r in rows} == {7} and [r["copy_"] for r in sorted(rows, key=lambda r: r["copy_"])] == list(range(1, len(rows) + 1))


def test_links_among_thousands_with_an_equal_half(spark):
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base, low, high = [rng.getrandbits(64) for _ in range(200)], rng.getrandbits(32), rng.getrandbits(32)
    prints = set(base)
    for x in base:
        for _ in range(4):
            flipped = x
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                flipped ^= 1 << bit
            prints.add(flipped)
    prints |= {rng.getrandbits(32) << 32 | low for _ in range(4000)} | {high << 32 | rng.getrandbits(32) for _ in range(1000)}
    listed = sorted(map(signed, prints))
    unsigned = np.array(listed, dtype=np.int64).view(np.uint64)
    expected = sorted((p, listed[j]) for i, p in enumerate(listed) for j in np.flatnonzero(np.bitwise_count(unsigned ^ unsigned[i]) <= 3) if p < listed[j])
    found = near_duplicates.links(spark.createDataFrame([(p,) for p in listed], "print long").repartition(8)).collect()
    assert sorted(map(tuple, found)) == expected

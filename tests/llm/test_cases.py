"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; skew; plan shapes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import (
    decontamination,
    language_id,
    language_model,
    license_scan,
    mixing,
    near_duplicates,
    quality_classifier,
    quality_rules,
    tool_calls,
    toxicity,
)

SENTENCE = "the cat and the dog sat on a mat in the house of a friend that we have not seen for years"


@pytest.fixture(scope="module")
def odd(docs_of):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, SENTENCE, "en", "a"), (4, SENTENCE, "en", "a"), (None, SENTENCE, "en", "b")]
    rows += [(5, SENTENCE.upper(), "de", None), (6, "wort " * 30_000, "de", "b"), (7, "你好 世界 ñ", "zh", "b"), (8, "x", "en", "b")]
    return docs_of(rows)


@pytest.fixture(scope="module")
def none(docs_of):
    return docs_of([])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 0, 0), (2, 0, 1), (4, 1, 0), (5, 1, 1), (6, None, 0), (7, 0, None), (99, 1, 1), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def run(odd, none, function, rows=10):
    """The function on the odd table, and on the empty one."""
    assert function(none).count() == 0
    found = function(odd).collect()
    assert rows is None or len(found) == rows
    return found


def test_rules(odd, none):
    found = run(odd, none, lambda d: quality_rules.apply_rules(d.select("doc_id", "text"), keep=["doc_id"]))
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert kept == {1: False, 2: False, 3: False, 4: True, None: True, 5: True, 6: False, 7: False, 8: False}
    assert {r["n_repeat_words"] for r in found if r["doc_id"] == 6} == {30_000}


def test_a_filter_stays_above_the_measures(odd):
    plan = quality_rules.apply_rules(odd.select("doc_id", "text"), keep=["doc_id"]).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") <= 2


def test_classifier(odd, none, labels):
    found = run(odd, none, lambda d: quality_classifier.classify(d, labels))
    assert all(0 <= r["score"] <= 1 for r in found)
    nothing = quality_classifier.classify(odd, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}


def test_toxicity(odd, none, labels):
    found = run(odd, none, lambda d: toxicity.classify(d, labels))
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in toxicity.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_disguised_words_are_restored():
    words = ("idiot stupid loser clown moron the and you are such a complete " * 5).split()
    counts = {}
    for word in words:
        padded = "  " + word + " "
        for i in range(2, len(padded)):
            for k in (1, 2, 3):
                counts[padded[i - k + 1 : i + 1]] = counts.get(padded[i - k + 1 : i + 1], 0) + 1
    restorer = toxicity.Restorer(toxicity.Characters(counts))
    assert restorer.words("You 1d10t, $tupid l0ser! stuuupid cl0wn***") == ["you", "idiot", "stupid", "loser", "stupid", "clown"]
    assert restorer.words("such i d i o t are") == ["such", "idiot", "are"]
    assert restorer.words("plain words stay 2024 --") == ["plain", "words", "stay"]


def test_language_id(odd, none):
    found = run(odd, none, lambda d: language_id.identify(d, docs_per_language=10, rounds=1))
    assert {r["lang_pred"] for r in found if r["id"] in (1, 2, 3)} == {"und"}


def test_all_cuts_of_a_word_are_summed():
    import numpy as np

    lattice = language_id.Lattice(["a", "b", "ab", "▁", "▁a"])
    p = np.zeros((lattice.size, 1))
    for piece, value in {"a": 0.2, "b": 0.3, "ab": 0.1, "▁": 0.25, "▁a": 0.05}.items():
        p[lattice.ids[piece]] = value
    # ▁|a|b, ▁|ab, ▁a|b
    assert np.exp(lattice.log_probabilities(["ab"], p))[0, 0] == pytest.approx(0.25 * 0.2 * 0.3 + 0.25 * 0.1 + 0.05 * 0.3)
    assert lattice.expected(["ab"], np.array([2.0]), p[:, 0]) @ np.ones(lattice.size) > 4


def test_language_model(odd, none):
    found = run(odd, none, lambda d: language_model.score(d, F.lit(True), chunks=3))
    by = {r["id"]: r for r in found}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1
    assert by[6]["n_tokens"] == by[6]["n_known"] == 30_001
    untaught = language_model.score(odd, F.lit(None).cast("boolean"), chunks=3).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in untaught} == {(0, 0)}


def test_mixture_weights_are_learned_from_all_documents(spark):
    import numpy as np

    rng = random.Random(11)
    texts = []
    for i in range(2500):
        topic = [f"t{i % 7}w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(3, 25))]
        texts.append(" ".join(w for word in topic for w in ((word, f"after_{word}") if rng.random() < (i % 10) / 10 else (word,))))
    split = [[*t.split(), ""] for t in texts]
    word, pair = Counter(), Counter()
    for words in split:
        word.update(words)
        pair.update(zip(["", *words], words))
    tokens = sum(word.values())
    estimates, contexts = [], []
    for words in split:
        own, own_pairs = Counter(words), Counter(zip(["", *words], words))
        for v, w in zip(["", *words], words):
            context = word[v] - own[v]
            contexts.append(context)
            estimates.append(((pair[v, w] - own_pairs[v, w]) / max(context, 1), (word[w] - own[w]) / tokens, 1 / tokens))
    buckets = language_model.bucket_of(np.array(contexts))
    mixture = language_model.learn(np.array(estimates), buckets, np.ones(len(buckets)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: r["score"] for r in language_model.score(docs, F.lit(True), chunks=5).collect()}
    for i, words in enumerate(split):
        expected = 0.0
        for v, w in zip(["", *words], words):
            a, b, c = mixture[language_model.bucket_of(np.array([word[v]]))[0]]
            expected += np.log10(a * pair[v, w] / word[v] + b * word[w] / tokens + c / (len(word) + 1))
        assert found[i] == pytest.approx(expected, rel=2e-4)


def test_near_duplicates(odd, none):
    found = run(odd, none, near_duplicates.near_duplicates)
    assert {r["component_id"] for r in found if r["id"] in (4, 5, None)} == {4}
    assert {(r["print"], r["component_id"]) for r in found if r["id"] in (1, 2, 3)} == {(0, 1)}


def test_links_at_every_distance(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for p in list(prints):
        for n in (1, 2, 3, 4):
            q = p
            for b in rng.sample(range(64), n):
                q ^= 1 << b
            prints.add(q)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = [(r["a"], r["b"]) for r in near_duplicates.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()]
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert len(found) == len(expected) and set(found) == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 300), (201, 300)]
    rng = random.Random(1)
    rng.shuffle(edges)
    found = {r["node"]: r["root"] for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found.get(i, i) for i in range(41)} == {0}
    assert {found.get(i, i) for i in range(100, 160)} == {100}
    assert {found.get(i, i) for i in (200, 201, 300)} == {200}


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, SENTENCE), (2, "X"), (3, None), (4, ""), (5, "dog sat")], "item_id long, text string")
    found = run(odd, none, lambda d: decontamination.contamination(d, items))
    by = {r["id"]: r for r in found}
    assert by[4]["n_hit"] == by[4]["n_words"] == 22 and by[4]["items"] == ["1", "5"] and by[8]["items"] == ["2"]
    assert by[1]["n_words"] == by[6]["n_hit"] == 0
    assert {r["n_hit"] for r in decontamination.contamination(odd, items.limit(0)).collect()} == {0}


def test_proximity(spark, docs_of):
    docs = docs_of([(1, "alpha one beta gamma", None, None), (2, "alpha beta gamma", None, None), (3, "alpha one two three four beta gamma", None, None)])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    known, _ = decontamination.phrases(items)
    terms = decontamination.vocabulary(known)
    index = decontamination.build_index(docs, terms)
    looked_up = decontamination.lists(known, terms, index)
    numbers = {r["text_no"]: r["id"] for r in index.where("term IS NULL").collect()}
    exact, near = ({numbers[r["text_no"]] for r in decontamination.matches(index, looked_up, slop).collect()} for slop in (0, 1))
    assert exact == {2} and near == {1, 2}


def test_mixing(odd, none):
    found = run(odd, none, mixing.with_copies)
    assert {r["size"] for r in found if r["row"]["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["copies"] <= 2 and r["target"] <= 2 * r["source_size"] for r in found)
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).columns == [*odd.columns, "copy_"]


def test_mixing_targets_sum_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100_000), ("c", 500), ("d", 0), (None, 70)], "source string, size long")
    found = {r["source"]: r for r in mixing.targets(sizes).collect()}
    assert sum(r["target"] for r in found.values()) == pytest.approx(1.5 * 100_580)
    assert found["a"]["target"] == 20 and found["d"]["target"] == 0 and found["c"]["target"] == 1000


def test_licenses(odd, none, docs_of):
    assert run(odd, none, license_scan.scan, rows=0) == []
    text = "Intro. " + license_scan.TEMPLATES["MIT-opening"].replace("hereby ", "") + " The end. Released under the MIT License."
    found = license_scan.scan(docs_of([(1, text, None, None)])).collect()
    assert [r["license"] for r in found] == ["MIT-opening", "MIT"]
    assert 0.9 < found[0]["coverage"] < 1 and text[found[0]["first_char"] :].startswith("Permission is granted")
    assert text[found[1]["first_char"] : found[1]["end_char"]] == "Released under the MIT License"


@pytest.mark.parametrize("between", [" ", "\n", " and then some other words stand here\n"])
def test_repeated_licenses_are_each_reported(between):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.7)
    for name, notice in license_scan.TEMPLATES.items():
        text = "Intro. " + between.join([notice] * 7)
        found = scanner.scan([None, text, notice])
        assert [(m[0], m[1], m[4]) for m in found] == [(1, name, 1.0)] * 7 + [(2, name, 1.0)]
        assert len({m[5] for m in found[:7]}) == 7
    # a worn occurrence between whole ones
    text = "Released under the MIT License. Released under the MIT. Released under the MIT License."
    assert [(m[1], m[2]) for m in scanner.scan([text])] == [("MIT", 5), ("MIT", 4), ("MIT", 5)]


CALLS = "conversation long, call_id string, position long, name string, arguments string, depends_on array<string>"


def test_tool_calls(spark):
    schemas = {"f": {"properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "string", "enum": ["p"]}}, "required": ["x"]}}
    rows = [
        (1, "a", 5, "f", '{"y": "p", "x": 1}', ["b", "zz"]),
        (1, "b", 9, "f", '{"x": -1}', []),
        (1, "c", 2, "f", '{"x": "1"}', ["a"]),
        (1, "d", 3, "g", "[1]", None),
        (2, "e", 1, "f", "{}", ["f"]),
        (2, "f", 2, "f", '{"x": null, "y": "q"}', ["e"]),
        (2, "g", 3, "f", "not json", ["f"]),
        (None, None, None, None, None, None),
    ]
    results = [("a", 6, "one"), ("a", 7, "two"), ("lost", 1, "?"), (None, None, None)]
    calls = spark.createDataFrame(rows, CALLS)
    answers = spark.createDataFrame(results, "call_id string, position long, content string")
    found = {(r["call_id"], r["status"]): r for r in tool_calls.link(calls, answers, schemas).collect()}
    assert len(found) == 10
    a, b, c = found["a", "linked"], found["b", "unanswered"], found["c", "unanswered"]
    assert (b["major"], b["minor"]) < (a["major"], a["minor"]) < (c["major"], c["minor"])
    assert a["errors"] == ["unknown call: zz"] and a["n_results"] == 2
    assert a["json"] == '{"arguments":{"x":1,"y":"p"},"depends_on":["b","zz"],"id":"a","name":"f","result":"one"}'
    assert b["errors"] == ["x: minimum"] and c["errors"] == ["x: wrong type"]
    assert found["d", "unanswered"]["errors"] == ["unknown tool", "arguments: not an object"]
    assert "x: missing" in found["e", "unanswered"]["errors"] and "cyclic references" in found["g", "unanswered"]["errors"]
    assert found["f", "unanswered"]["errors"] == ["x: missing", "y: enum", "cyclic references"]
    assert found["lost", "orphan"]["valid"] is None
    assert tool_calls.link(calls.limit(0), answers.limit(0), schemas).count() == 0


def test_pipeline_stages(spark, odd, none, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns or name == "mixing" and set(docs.columns) <= set(out.columns), name
            assert docs is odd or out.count() == 0
    one = corpus_pipeline.one_of_each(spark, odd, str(tmp_path)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in one) == [1, 4, 6, 7, 8]


def test_pipeline_decides_by_row(spark, docs_of, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, SENTENCE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(30)) for _ in range(5))
    leak = f"{a} {SENTENCE}"
    # copies of a with and without an id; copies of b without; two texts under one id; single texts without
    docs = docs_of([(i, t, "en", "s") for i, t in [(1, a), (None, a), (None, b), (None, b), (None, b), (2, c), (2, d), (2, d), (None, e), (None, leak)]])
    one = corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    assert Counter(map(tuple, one)) == Counter([(1, a), (None, b), (2, c), (2, d), (None, e), (None, leak)])
    docs = docs.unionByName(docs_of([(2, leak, "en", "s")]))
    clean = corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    assert Counter(map(tuple, clean)) == Counter([(1, a), (None, a), *[(None, b)] * 3, (2, c), (2, d), (2, d), (None, e)])

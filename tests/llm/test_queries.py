"""The registered queries: against SQL, against brute force, and on held-out labels."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import connect, differences

import __spark_entry__ as driver

QUERIES = {k: f for k, f in driver.queries().items() if re.match(r"op\d+_|pipeline$", k)}
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    made = {}

    def get(n):
        name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
        if name not in made:
            made[name] = QUERIES[name](spark, sf_dir).toArrow().to_pylist()
        return made[name]

    return get


@pytest.fixture(scope="module")
def given(read):
    return {name: read(name).toArrow().to_pylist() for name in ("documents", "labels")}


def test_registered():
    assert sorted(int(re.match(r"op(\d+)", k)[1]) for k in QUERIES if k != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("n", [1, 4, 5, 8, 11, 12, 13])
def test_matches_sql(spark, sf_dir, n):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    theirs = connect(sf_dir).sql(driver.oracle_sql()[name]).to_arrow_table()
    assert not differences(QUERIES[name](spark, sf_dir).toArrow(), theirs)


@pytest.mark.parametrize("n, label, least", [(2, "quality", 0.97), (7, "toxic", 0.9)])
def test_held_out_labels(result, given, n, label, least):
    truth = {r["doc_id"]: r[label] for r in given["labels"]}
    rows = result(n)
    assert len(rows) == len(given["documents"])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(held) >= least * len(held)


def test_held_out_languages(result, given):
    lang = {r["doc_id"]: r["lang"] for r in given["documents"]}
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in result(9) if r["held_out"]]
    assert sum(held) >= 0.97 * len(held)


def test_licenses_are_found_where_they_are(result, given):
    notices = ("Licensed under the Apache License", "Released under the MIT License", "Licensed under CC BY-NC 4.0", "under the GNU General Public License, version 3")
    expected = {r["doc_id"] for r in given["documents"] if any(n in r["text"] for n in notices)}
    texts = {r["doc_id"]: r["text"] for r in given["documents"]}
    assert {r["doc_id"] for r in result(3)} == expected
    for r in result(3):
        assert "icense" in texts[r["doc_id"]][r["first_char"] : r["end_char"]]


def test_language_model_counts(result, given):
    counts, texts = Counter(), {}
    for r in given["documents"]:
        words = [*BLANK.findall(lower(r["text"])), ""]
        texts[r["doc_id"]] = words
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    gain = []
    for r in result(6):
        words = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert abs(base - r["base_score"]) < 1e-6 * abs(base) + 1e-9
        if r["held_out"]:
            gain.append(r["score"] - base)
    assert sum(gain) > 0


def brute_prints(texts):
    out = []
    for text in texts:
        words = BLANK.findall(lower(text))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def brute_components(ids, prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = np.array(sorted(parent), dtype=np.uint64)
    for i, p in enumerate(distinct):
        for q in distinct[i + 1 :][np.bitwise_count(distinct[i + 1 :] ^ p) <= 3]:
            a, b = find(int(p)), find(int(q))
            parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 62)
    for i, p in zip(ids, prints):
        least[find(p)] = min(least[find(p)], i)
    return [least[find(p)] for p in prints]


def test_near_duplicates_against_brute_force(result, given):
    docs = given["documents"]
    prints = brute_prints([d["text"] for d in docs])
    roots = brute_components([d["doc_id"] for d in docs], prints)
    expected = {d["doc_id"]: (f"{p:016x}", root) for d, p, root in zip(docs, prints, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(10)} == expected
    assert len(set(roots)) < len(docs)


def test_pipeline_stages_take_effect(spark, sf_dir, given, result):
    import corpus_pipeline

    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "clean", "one_of_each", "decontaminated", "mixed"]
    out = corpus_pipeline.run(spark, sf_dir).toArrow().to_pylist()
    kept = {r["doc_id"] for r in out}
    assert kept <= {r["doc_id"] for r in result(8) if r["kept"]}
    assert not kept & {r["doc_id"] for r in result(4) if r["contaminated"]}
    texts = {d["doc_id"]: d["text"] for d in given["documents"]}
    prints = brute_prints([texts[i] for i in sorted(kept)])
    assert len(set(prints)) == len(prints)
    copies = Counter((r["doc_id"], r["copy"]) for r in out)
    assert max(copies.values()) == 1 and max(r["copy"] for r in out) <= 2



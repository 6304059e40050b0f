"""Page wrappers, Merkle manifests and periodic runs: against brute force, on odd tables, and on spread-out groups."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import merkle, periodic_runs, wrappers

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(docs_of):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "x y z", "en", "a"), (4, "x y z", "en", "a"), (None, "x y z", "en", "b")]
    rows += [(5, "ja " * 7, "de", None), (6, "wort " * 30_000, "de", "b"), (7, "你好 世界 ñ", "zh", "b"), (8, "a b", "en", "b"), (None, "x y z", "en", "b")]
    return docs_of(rows)


# Periodic runs


def brute_runs(words, least=6, exponent=4):
    """Every maximal stretch of every period, by definition."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def runs_by(texts):
    return [runs for _, runs, _ in periodic_runs.found_in([t.encode() for t in texts], 6, 4)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4))
def test_runs_over_two_words_against_brute_force(texts):
    texts = [" ".join(t) for t in texts]
    assert runs_by(texts) == [brute_runs(t.split()) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_pieces_against_brute_force(pieces):
    words = list("".join(p * n for p, n in pieces))
    assert runs_by([" ".join(words)]) == [brute_runs(words)]


def test_runs_over_batches(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(50)]
    whole = runs_by(texts)
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 64)
    assert runs_by(texts) == whole == [brute_runs(t.split()) for t in texts]


def test_runs_on_odd_texts(odd):
    found = periodic_runs.find_runs(odd).collect()
    assert len(found) == 11
    by_id = {r["id"]: r for r in found}
    assert [tuple(r) for r in by_id[6]["runs"]] == [(0, 30_000, 1)] and by_id[6]["collapsed"] == "wort"
    assert [tuple(r) for r in by_id[5]["runs"]] == [(0, 7, 1)] and by_id[5]["collapsed"] == "ja"
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == by_id[3]["n_words"] == 0 and by_id[1]["collapsed"] == ""
    # only ASCII blanks part words
    assert by_id[8]["n_words"] == 1 and by_id[8]["collapsed"] == "a b"
    assert sum(r["id"] is None for r in found) == 2
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0


def test_runs_need_four_periods():
    with pytest.raises(ValueError):
        periodic_runs.finder(exponent=3)


def test_runs_move_no_rows(odd):
    assert "Exchange" not in periodic_runs.find_runs(odd)._jdf.queryExecution().executedPlan().toString()


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves, arity):
    """The root, and for every leaf the digests left and right of its way."""
    ways, nodes = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for s, (_, below) in enumerate(run):
                for leaf in below:
                    ways[leaf].append(("".join(d for d, _ in run[:s]), "".join(d for d, _ in run[s + 1 :])))
            above.append((sha("".join(d for d, _ in run)), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], ways


def brute_manifest(rows, arity):
    """``{(id, leaf): (subroot, root, way)}`` of rows ``(id, group, text)``."""
    groups = {}
    for i, group, text in rows:
        groups.setdefault(group, []).append((i is not None, i or 0, brute_leaf((i, group, text)), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([m[2] for m in sorted(groups[g], key=lambda m: m[:3])], arity) for g in names}
    root, ways = brute_tree([trees[g][0] for g in names], arity)
    found = {}
    for g, over in zip(names, ways):
        for (_, _, leaf, i), way in zip(sorted(groups[g], key=lambda m: m[:3]), trees[g][1]):
            found.setdefault((i, leaf), []).append((trees[g][0], root, [*way, *over]))
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("arity, hot", [(2, 41), (3, 100), (4, 3)])
def test_manifest_against_brute_force(spark, arity, hot):
    rng = random.Random(arity)
    rows = [(i, "hot", f"text {i}") for i in range(hot)] + [(i, rng.choice("abcdefgh"), "t" * (i % 5)) for i in range(200, 260)]
    rows += [(1, None, None), (2, "", ""), (None, "a", "x"), (None, "a", "y"), (3, "é", "ü"), (7, "same", "t"), (7, "same", "t"), (7, "same", "t")]
    df = spark.createDataFrame(rows, "id long, grp string, text string").repartition(7)
    found = {}
    for r in merkle.manifest(df, "grp", "id", merkle.leaf([df["id"], df["grp"], df["text"]]), arity=arity).withColumn("to", merkle.folded(F.col("digest"), F.col("way"))).collect():
        assert r["to"] == r["root"]
        way = [(s["left"].hex(), s["right"].hex()) for s in r["way"]]
        found.setdefault((r["id"], r["digest"].hex()), []).append((r["subroot"].hex(), r["root"].hex(), way))
    assert {k: sorted(v) for k, v in found.items()} == brute_manifest(rows, arity)


def test_manifest_of_odd_rows(odd, spark):
    leaf = merkle.leaf([odd[c] for c in ("doc_id", "source", "lang", "n_chars", "text")])
    changed = merkle.leaf([odd["doc_id"], odd["source"], odd["lang"], odd["n_chars"], F.upper(odd["text"])])
    made = merkle.manifest(odd, "source", "doc_id", leaf, {"given": changed, "at": odd["copy"], "left": odd["kept"]})
    rows = made.withColumn("to", merkle.folded(F.col("given"), F.col("way"))).select("id", "root", "to", "at", "left").collect()
    assert len(rows) == 11 and len({r["root"] for r in rows}) == 1 and {r["at"] for r in rows} == {9} and {r["left"] for r in rows} == {"k"}
    # only those without a lower-case letter, and null, stay as they were
    assert {r["id"] for r in rows if r["to"] == r["root"]} == {1, 2, 3}
    assert merkle.manifest(odd.limit(0), "source", "doc_id", leaf).count() == 0


def test_one_row_is_its_own_root(spark):
    df = spark.createDataFrame([(1, "a", "t")], "id long, grp string, text string")
    row = merkle.manifest(df, "grp", "id", merkle.leaf([df["text"]])).first()
    assert row["digest"] == row["subroot"] == row["root"] == bytes.fromhex(sha("1:t")) and row["way"] == []


def test_a_hot_group_is_numbered_in_many_tasks(spark):
    df = spark.range(20_000).select(F.struct(F.lit("g").alias("value")).alias("grp"), F.lit(1).alias("id"), F.lit(b"d").alias("digest"))
    numbered = merkle.numbered(df.repartition(8), ["id", "digest"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = numbered.agg(F.count_distinct("at").alias("n"), F.max("at").alias("last"), F.max("of").alias("of")).first()
    assert tuple(got) == (20_000, 19_999, 20_000)


# Wrappers


def text_of(markup, *others):
    """The main text of a page of a host that has the other pages too."""
    made = wrappers.wrapper_of(markup)
    for other in others:
        made = wrappers.aligned(made, wrappers.wrapper_of(other))
    return wrappers.main_text(markup, wrappers.Sequence(made))


MARKED = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script><style>p{}</style></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies</div>
<article class="post comments-open"><header><h1>Head &amp; line</h1></header><p>One&nbsp;<b>two</b>
three<p>Four <span class="ad">buy</span>five<div class="share">Share</div><ul><li>a<li>b &lt;c&gt;</ul><form><input><button>Go</button></form>
<footer>by me</footer><section class="comment-list"><p>First!</p></section></article><aside>More</aside><footer>&copy; us</footer>"""


def test_text_of_a_marked_page():
    assert text_of(MARKED) == "Head & line\n\nOne two three\n\nFour\n\nfive\n\na\n\nb <c>"


def plain(k, rows=3):
    body = "".join(f"<p>Paragraph {k} {i} with enough words to be read</p>" for i in range(rows))
    return f"<html><body><div class=top>Best site</div><div><a href=1>One {k}</a> <a href=2>Two</a></div><div class=c><h1>Story {k}</h1>{body}</div><div>All rights</div></body></html>"


def test_template_and_menus_of_unmarked_pages_are_learned():
    pages = [plain(k, 1 + k % 4) for k in range(6)]
    paragraphs = [f"Paragraph 2 {i} with enough words to be read" for i in range(3)]
    assert text_of(pages[2], *pages) == "\n\n".join(["Story 2", *paragraphs])
    # a page alone can't tell its template, nor can copies of it
    assert text_of(pages[2], *[pages[2]] * 9) == "\n\n".join(["Best site", "Story 2", *paragraphs, "All rights"])


def test_optional_and_repeated_groups():
    def of(shape):
        return wrappers.expression([(s, []) for s in shape], 0)

    def written(items):
        return "".join(("(" + written(b) + ")" if s[0] == "(" else s) + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[o, r] for s, o, r, b in items)

    assert written(of("aaa")) == "a+"
    assert written(of("xababab")) == "x(ab)+"
    assert written(wrappers.aligned(of("axc"), of("ac"))) == "ax?c"
    assert written(wrappers.aligned(of("xababy"), of("xaby"))) == "x(ab)+y"
    assert written(wrappers.aligned(of("ab"), of("cb"))) == "a?c?b"


TREES = st.recursive(st.just([]), lambda inner: st.lists(st.tuples(st.sampled_from("abc"), inner), max_size=7), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=5))
def test_a_wrapper_accepts_every_page_it_was_made_of(pages):
    made = wrappers.expression(pages[0], 0)
    for page in pages[1:]:
        made = wrappers.aligned(made, wrappers.expression(page, 0))
    sequence = wrappers.Sequence(made)
    assert all(sequence.accepts(page) for page in pages)


@settings(max_examples=200, deadline=None)
@given(st.text("<>/!-\"'= apbdivscript&;#x", max_size=80))
def test_broken_markup_never_fails(markup):
    assert isinstance(text_of(markup, MARKED), str)


def test_deep_and_long_pages():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == "deep\n\nafter"
    assert len(text_of("<main>" + "<p>word</p>" * 50_000)) == 50_000 * 6 - 2
    assert text_of("<main>" + "".join(f"<h2>{i}</h2>" + "<p>x</p>" * (i % 3) for i in range(200))).count("x") == sum(i % 3 for i in range(200))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(None, None, None), (1, "http://h.example/1", ""), (2, None, "<p>a"), (2, "nonsense", "<p>a"), (3, "HTTP://H.example:80/x", "<main>b<main>c")]
    rows += [(10 + k, f"http://hot.example/{k}", plain(k % 50)) for k in range(400)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")


def test_extraction_on_odd_pages(pages):
    rows = wrappers.extract(pages.repartition(40)).collect()
    assert len(rows) == 405
    found = {(r["id"], r["url"]): r["text"] for r in rows}
    assert found[None, None] == found[1, "http://h.example/1"] == "" and found[2, None] == found[2, "nonsense"] == "a"
    assert found[3, "HTTP://H.example:80/x"] == "b\n\nc"
    assert found[13, "http://hot.example/3"].startswith("Story 3\n\nParagraph 3 0") and "All rights" not in found[13, "http://hot.example/3"]
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_wrappers_are_merged_few_at_a_time(spark, pages, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    one = {r["host"]: r["wrapper"] for r in wrappers.infer(pages.coalesce(1)).collect()}
    many = wrappers.infer(pages.repartition(60)).collect()
    assert sorted(r["host"] for r in many) == sorted(one) == ["", "h.example", "hot.example"]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffled = wrappers.extract(pages.repartition(60))
        assert shuffled.count() == 405 and "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

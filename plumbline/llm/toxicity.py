"""Toxicity through a noisy channel: text is restored by Viterbi decoding, then scored.

Writers hide words by look-alike signs (leetspeak), by spacing letters out and by repeating them. Each
written token becomes a lattice of what it may stand for; the best path under a character trigram model
of ordinary words, less the channel's costs, is the restored text. Tokens of letters alone, without a
run of three, have one path and stay as they are.

Restored words are scored by what learned from labelled rows: whole words and word beginnings that
stand in significantly more toxic documents than others (a likelihood ratio test, corrected for the
number of tests). A document's best and second-best weights and its count of such words go through a
logistic regression. The fit reads every labelled row whose remainder is not 0: the characters, the words, the size of the test
and the regression are all counted over all of them. Equal rows and near copies of one class share the weight of one row. To the
driver come the character n-grams and the weighing words, whose numbers grow with the alphabet and the vocabulary, and the sums
of a regression step. Who wants a quicker fit on fewer rows may ask for about ``rows_per_class`` of each class, drawn by a hash
of id and text; without it none is left out.

Null and empty texts have no evidence and get the score of that. Without labelled rows of both classes
no word weighs anything and every score is 0.5, or the one class. Ties and repeated rows score alike; texts are read whole,
of any length. An id with several
labels counts as toxic if one says so. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, blank_words, remainder, shipped, small
from plumbline.session import stage

shipped(__name__)

# Signs and the letters they stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l",
    "¡": "i", "×": "x", "¢": "c", "§": "s", "&": "a", "#": "h", "%": "x", "*": "aeiou",
}

#: Costs of the channel, in natural logarithms.
LOOKALIKE, DROPPED, KEPT_SIGN, ONE_OF_RUN, TWO_OF_RUN, JOINED, PARTED = 1.0, 2.5, 4.0, 0.3, 0.7, 0.1, 5.0

#: Beginnings of words that are features, by length; a whole word is one too.
BEGINNINGS = range(3, 9)
#: Tokens that a task remembers, with their restorations or as weighing nothing.
REMEMBERED = 300_000
#: Different features that a task counts before it passes them on.
COUNTED = 200_000
#: Hashes kept of a text to compare it with others, the smallest of its runs of four words.
SKETCH = 16
EDGE = " "
RUN = re.compile(r"(\w)\1\1")
ORNAMENT = ".,;:?\"'()[]{}<>«»“”„…-–—_/\\"


ORNAMENT_RUN = re.compile(r"^(?:!!+|([^\w\s])\1\1+)|(?:!!+|([^\w\s])\2\2+)$")


class Characters:
    """A character trigram model of words, interpolated with its bigrams and unigrams."""

    def __init__(self, counts: dict[str, int]):
        """``counts``: how often each string of three, two and one characters ends in its last one."""
        self.counts = counts
        self.total = max(1, sum(n for k, n in counts.items() if len(k) == 1))
        self.known = max(1, sum(len(k) == 1 for k in counts))
        self.contexts: Counter = Counter()
        for k, n in counts.items():
            if len(k) > 1:
                self.contexts[k[:-1]] += n
        self.memory: dict[str, float] = {}

    def cost(self, three: str) -> float:
        """Minus the log probability of the third character after the two before it."""
        found = self.memory.get(three)
        if found is None:
            p = (self.counts.get(three[2], 0) + 0.1) / (self.total + 0.1 * (self.known + 1000))
            for k in (three[1:], three):
                n = self.contexts.get(k[:-1], 0)
                p = (self.counts.get(k, 0) + 5.0 * p) / (n + 5.0)
            found = self.memory[three] = -math.log(p)
        return found


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """The alternatives (string, cost) at each place of a token, or of a run of spaced-out letters."""
    places: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(written):
        sign = written[at]
        end = at + 1
        while end < len(written) and written[end] == sign:
            end += 1
        run = end - at
        if sign == " ":
            places.append([("", JOINED), (" ", PARTED)])
        elif sign.isalpha():
            places.append([(sign, 0.0)] if run == 1 else [(sign, ONE_OF_RUN), (sign * 2, 0.0 if run == 2 else TWO_OF_RUN)])
        else:
            options = [(letter * k, LOOKALIKE) for letter in LOOKALIKES.get(sign, "") for k in range(1, min(run, 2) + 1)]
            options.append((sign, KEPT_SIGN) if sign.isdigit() else ("", DROPPED if run == 1 else ONE_OF_RUN))
            places.append(options)
        at = end
    return places


def decode(written: str, model: Characters) -> str:
    """The cheapest path through the lattice of ``written`` (Viterbi over the last two characters)."""
    paths = {EDGE + EDGE: (0.0, "")}
    for options in lattice(written):
        ahead: dict[str, tuple[float, str]] = {}
        for state, (spent, text) in paths.items():
            for string, price in options:
                cost, last = spent + price, state
                for char in string:
                    cost += model.cost(last + char)
                    last = EDGE + EDGE if char == EDGE else last[1] + char
                held = ahead.get(last)
                if held is None or (cost, text + string) < held:
                    ahead[last] = (cost, text + string)
        paths = ahead
    return min((spent + (model.cost(state + EDGE) if state != EDGE + EDGE else 0.0), text) for state, (spent, text) in paths.items())[1]


class Restorer:
    """Restores tokens and texts, remembering tokens."""

    def __init__(self, model: Characters):
        self.model = model
        self.memory: dict[str, str] = {}

    def token(self, token: str) -> str:
        """A lower-case token without blanks, restored; empty if it has no letter."""
        found = self.memory.get(token)
        if found is None:
            found = token if token.isalpha() and not RUN.search(token) else self._decoded(token)
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[token] = found
        return found

    def _decoded(self, token: str) -> str:
        core = token.strip(ORNAMENT)
        if not any(c.isalpha() for c in core):
            return ""
        # three equal signs around a word, or two of !, are ornament; fewer may be letters
        core = ORNAMENT_RUN.sub("", core)
        if core.isalpha() and not RUN.search(core):
            return core
        return decode(core, self.model)

    def parts(self, text: str | None) -> tuple[set[str], list[str]]:
        """The different tokens of a text, without runs of spaced-out letters, and the words that these make."""
        tokens = (text or "").lower().split()
        different = set(tokens)
        signs = {token for token in different if len(token) == 1 and (token.isalnum() or token in LOOKALIKES)}
        ones = [i for i, token in enumerate(tokens) if token in signs] if signs else []
        if not any(last - first == 3 for first, last in zip(ones, ones[3:])):
            return different, []
        made: list[str] = []
        at = 0
        while at < len(ones):
            end = at + 1
            while end < len(ones) and ones[end] == ones[end - 1] + 1:
                end += 1
            if end - at > 3:
                run = slice(ones[at], ones[end - 1] + 1)
                made.extend(decode(" ".join(tokens[run]), self.model).split())
                tokens[run] = [""] * (end - at)
            at = end
        return set(tokens) - {""}, made

    def alone(self, token: str) -> str:
        """What a token is that is no part of a run: one letter, digit or look-alike stays as it is."""
        return token if len(token) == 1 and (token.isalnum() or token in LOOKALIKES) else self.token(token)

    def different(self, text: str | None) -> set[str]:
        """The different restored words of a text; those of ``words``."""
        tokens, made = self.parts(text)
        return {*map(self.alone, tokens), *made} - {""}

    def words(self, text: str | None) -> list[str]:
        """The restored words of a text, in order."""
        out: list[str] = []
        spaced: list[str] = []

        def flush() -> None:
            if len(spaced) > 3:
                out.extend(decode(" ".join(spaced), self.model).split())
            else:
                out.extend(spaced)
            spaced.clear()

        for token in (text or "").lower().split():
            if len(token) == 1 and (token.isalnum() or token in LOOKALIKES):
                spaced.append(token)
                continue
            if spaced:
                flush()
            word = self.token(token)
            if word:
                out.append(word)
        flush()
        return out


def features(word: str) -> list[str]:
    return [word[:k] for k in BEGINNINGS if k <= len(word)] + [word + "$"]


def features_of(words: set[str]) -> set[str]:
    """The different features of several words."""
    found = {word + "$" for word in words}
    for k in BEGINNINGS:
        found.update([word[:k] for word in words if len(word) >= k])
    return found


class Scorer:
    """Evidence and score of texts under weights of features and a logistic regression."""

    def __init__(self, restorer: Restorer, weights: dict[str, float], coefficients: list[float]):
        self.restorer, self.weights, self.coefficients = restorer, weights, coefficients
        #: How the words that weigh begin.
        self.starts = {start for f in weights for start in (f[:3], f.removesuffix("$")[:3])}
        #: Tokens known to weigh nothing.
        self.idle: set[str] = set()

    def weight(self, word: str) -> float:
        return max(map(self.weights.get, features(word), repeat(0.0)))

    def weighing(self, text: str | None) -> set[str]:
        """The different restored words of a text that weigh something."""
        tokens, made = self.restorer.parts(text)
        if len(self.idle) >= REMEMBERED:
            self.idle.clear()
        found = {word for word in made if self.weight(word) > 0}
        for token in tokens - self.idle:
            if token[:3] not in self.starts and token.isalpha() and not RUN.search(token):
                self.idle.add(token)
                continue
            word = self.restorer.alone(token)
            if word and word[:3] in self.starts and self.weight(word) > 0:
                found.add(word)
            else:
                self.idle.add(token)
        return found

    def evidence(self, text: str | None) -> list[float]:
        """1, the two best weights of different words, and the log number of different weighing words."""
        found = sorted(map(self.weight, self.weighing(text)), reverse=True)
        return [1.0, *(found + [0.0, 0.0])[:2], math.log1p(len(found))]

    def score(self, text: str | None) -> float:
        x = sum(a * b for a, b in zip(self.evidence(text), self.coefficients))
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x))))


def _spaced_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Character n-grams of plain words, counted within each batch."""
    for batch in batches:
        for weight, texts in batch.groupby("weight")["text"]:
            tokens: Counter = Counter()
            for text in texts:
                tokens.update((text or "").lower().split())
            words: Counter = Counter()
            for token, n in tokens.items():
                words[token.strip(ORNAMENT)] += n
            threes: Counter = Counter()
            for word, n in words.items():
                if word.isalpha() and not RUN.search(word):
                    padded = EDGE + EDGE + word + EDGE
                    for i in range(len(padded) - 2):
                        threes[padded[i : i + 3]] += n
            grams: Counter = Counter()
            for three, n in threes.items():
                for k in (1, 2, 3):
                    grams[three[-k:]] += n
            if grams:
                yield pd.DataFrame({"gram": list(grams), "n": [n * weight for n in grams.values()]})


def _total(column: str) -> Column:
    """The sum of weights, the same in whatever order they are added."""
    return F.round(F.sum(column), 6)


def _alike(one: Column, other: Column) -> Column:
    """Whether half of the runs of two texts are in both, judged by the smallest hashes of either."""
    both = F.slice(F.sort_array(F.array_union(one, other)), 1, SKETCH)
    return 2 * F.size(F.array_intersect(both, F.array_intersect(one, other))) >= F.size(both)


def _weights(known: DataFrame) -> DataFrame:
    """``row, label, weight``: near copies of one class share a weight of one.

    ``known`` holds ``row, label, copies, low, high, sketch``. Near copies agree in their smallest or largest hash, mostly. As
    quite different texts may too, only those whose sketches are alike share. No row is left out.
    """
    rows = known.withColumn("first", F.col("row"))
    for key in ("low", "high"):
        firsts = rows.where("first = row").select("label", key, "row", "sketch")
        heads = firsts.groupBy("label", key).agg(F.min(F.struct("row", "sketch")).alias("head"), F.count("*").alias("n"))
        # groups of several only, so that most rows need not be dealt by their groups
        heads = small(stage(heads.where("n > 1").drop("n"), "heads"))
        moved = firsts.join(heads, ["label", key]).where((F.col("row") != F.col("head.row")) & _alike(F.col("sketch"), F.col("head.sketch")))
        moved = small(stage(moved.select(F.col("row").alias("first"), F.col("head.row").alias("other")), "moved"))
        rows = rows.join(moved, "first", "left").withColumn("first", F.coalesce("other", "first")).drop("other")
    rows = stage(rows.select("row", "label", "copies", "first"), "copies")
    sizes = small(stage(rows.groupBy("first").agg(F.sum("copies").alias("n")).where("n > 1"), "sizes"))
    weight = (1.0 / F.coalesce("n", F.lit(1))).alias("weight")
    return stage(rows.join(sizes, "first", "left").select("row", "label", weight), "weights")


def _sample(
    docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, folds: int, rows_per_class: int | None = None
) -> DataFrame:
    """``text, label, weight`` of every training row, or of about ``rows_per_class`` different ones of each class if that is given.

    Rows are drawn, not ids: an id may be that of many texts. Rows equal in id and text, and near copies, share a weight of one.
    """
    truth = labels.where(labels[label].isin(0, 1)).groupBy(labels[id].alias("id")).agg(F.max(label).alias("label"))
    truth = truth.where(remainder(F.col("id"), folds) != 0)
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"), F.xxhash64(docs[id], docs[text]).alias("row"))
    truth = stage(truth, "truth")
    few = truth.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # hashes of four words in a row; rows without a label need none, if that can be told without shuffling the texts
    hashed = rows.join(F.broadcast(truth.select("id")), "id", "left_semi") if few else rows
    hashed = hashed.withColumn("h", F.transform(blank_words(F.col("text")), lambda w: F.xxhash64(w)))
    for step in (1, 2):
        hashed = hashed.withColumn("h", F.expr(f"zip_with(h, slice(h, {step + 1}, size(h)), (a, b) -> xxhash64(a, b))"))
    sketch = F.slice(F.sort_array(F.array_distinct("h")), 1, SKETCH).alias("sketch")
    hashed = hashed.select("id", "row", sketch, F.coalesce(F.array_max("h"), F.lit(0)).alias("high"))
    # ids and hashes only: the texts are not shuffled to find out which are labelled
    known = hashed.join(small(truth), "id").groupBy("row").agg(
        F.max("label").alias("label"), F.count("*").alias("copies"), F.max("high").alias("high"), F.max("sketch").alias("sketch")
    )
    known = stage(known.withColumn("low", F.coalesce(F.array_min("sketch"), F.lit(0))), "known")
    if rows_per_class is not None:
        sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
        draw = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
        share = F.lit(1.0)
        for value, n in sizes.items():
            share = F.when(F.col("label") == value, min(1.0, rows_per_class / n)).otherwise(share)
        known = known.where(draw < share)
    weights = _weights(known)
    return stage(rows.select("row", "text").join(small(weights), "row").select("text", "label", "weight"), "labelled")


def _logistic(seen: DataFrame, ridge: float = 0.01) -> list[float]:
    """Newton's method with a small ridge over ``y, a, b, c, d, n``, n rows each; classes weigh as they are.

    A step is one aggregation: the gradient and the curvature are sums over all rows.
    """
    names = list("abcd")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    w = np.zeros(len(names))
    for _ in range(50):
        z = sum((F.col(c) * float(x) for c, x in zip(names, w)), F.lit(0.0))
        p = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        at = seen.select("y", "n", *names, p.alias("p"))
        slopes = [F.sum(F.col("n") * (F.col("p") - F.col("y")) * F.col(c)) for c in names]
        bends = [F.sum(F.col("n") * F.col("p") * (1.0 - F.col("p")) * F.col(names[i]) * F.col(names[j])) for i, j in pairs]
        sums = at.agg(*slopes, *bends).first()
        gradient = np.array(sums[: len(names)]) + ridge * w
        curvature = ridge * np.eye(len(names))
        for (i, j), x in zip(pairs, sums[len(names) :]):
            curvature[i, j] += x
            if i != j:
                curvature[j, i] += x
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, rows_per_class: int | None = None) -> Scorer:
    rows = _sample(docs, labels, id, text, label, folds, rows_per_class)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(_total("weight").alias("n")).collect()}
    grams = rows.select("text", "weight").mapInPandas(_spaced_counts, "gram string, n double").groupBy("gram").agg(_total("n").alias("n"))
    # rare trigrams say no more than the bigrams they are smoothed by
    restorer = Restorer(Characters({r["gram"]: r["n"] for r in grams.where("length(gram) < 3 OR n > 2").collect()}))
    if len(sizes) < 2:
        base = float(next(iter(sizes), 0.5))
        return Scorer(restorer, {}, [(base - 0.5) * 20.0, 0.0, 0.0, 0.0])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counts(seen: Counter, value: int, weight: float) -> pd.DataFrame:
            n = np.fromiter(seen.values(), float, len(seen)) * weight
            return pd.DataFrame({"feature": list(seen), "clean": n * (1 - value), "toxic": n * value})

        for batch in batches:
            for (value, weight), texts in batch.groupby(["label", "weight"])["text"]:
                seen: Counter = Counter()
                for body in texts:
                    seen.update(features_of(restorer.different(body)))
                    if len(seen) >= COUNTED:
                        yield counts(seen, value, weight)
                        seen.clear()
                if seen:
                    yield counts(seen, value, weight)

    counted = rows.mapInPandas(count, "feature string, clean double, toxic double")
    counted = stage(counted.groupBy("feature").agg(_total("clean").alias("clean"), _total("toxic").alias("toxic")), "features")
    n0, n1 = float(sizes[0]), float(sizes[1])
    a, b = F.col("toxic"), F.col("clean")
    together = (a + b) / (n0 + n1)

    def part(observed, expected):
        return F.when((observed > 0) & (expected > 0), observed * F.log(observed / expected)).otherwise(0.0)

    ratio = 2 * (part(a, n1 * together) + part(b, n0 * together) + part(n1 - a, n1 * (1 - together)) + part(n0 - b, n0 * (1 - together)))
    tests = counted.where("clean + toxic > 2").count()
    kept = counted.where((a / n1 > b / n0) & (ratio > 2 * math.log(max(2, tests)) + 2))
    weight = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    weights = {r["feature"]: r["w"] for r in kept.select("feature", weight.alias("w")).collect()}
    untrained = Scorer(restorer, weights, [0.0] * 4)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[y, *untrained.evidence(t), n] for t, y, n in zip(batch["text"], batch["label"], batch["weight"])]
            yield pd.DataFrame(found, columns=list("yabcdn"))

    seen = rows.mapInPandas(look, "y double, a double, b double, c double, d double, n double")
    return Scorer(restorer, weights, _logistic(stage(seen.groupBy(*"yabcd").agg(_total("n").alias("n")), "evidence")))


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of the table and the score."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(scorer.score).astype("float64")

    return docs.withColumn(score, of(docs[text]))


def restored(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "restored") -> DataFrame:
    """All columns of the table and the restored words of the text, joined by blanks."""
    restorer = scorer.restorer

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(restorer.words(t)))

    return docs.withColumn(out, of(docs[text]))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, cut: float = 0.5, rows_per_class: int | None = None) -> DataFrame:
    """``id, held_out, score, predicted`` for every document; rows whose remainder is 0 teach nothing."""
    scorer = fit(docs, labels, id, text, label, folds, rows_per_class)
    rows = scored(docs.select(docs[id].alias("id"), docs[text].alias("text")), scorer)
    return rows.select("id", (remainder(F.col("id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

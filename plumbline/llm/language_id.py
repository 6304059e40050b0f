"""Language identification by unigrams over pieces, with the segmentation summed out.

A word's probability in a language is the sum over all ways to cut it into pieces of a fixed public
vocabulary, each way the product of its pieces' probabilities there: a forward pass over the word. The
piece probabilities are learned by expectation-maximisation, a backward pass giving each piece's expected
count. A text's log probability is the sum over its words; the score is the posterior of the best
language when all are equally likely beforehand.

The fit reads at most about ``docs_per_language`` documents of each language, chosen by a hash of the
id, the text and the row's place, and brings the driver a row per language and piece. Texts are cut to runs of letters and
read in lower case. Runs are summed whole, however long, in numbers scaled on the way.

A null text, or one without a letter, is ``und`` with score 0. Rows with a null language or text teach nothing, those
without an id or with the same one do as well as others. Ties go to the smallest name. Without rows to learn from, every text is
``und``. Repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import remainder, shipped
from plumbline.session import stage

shipped(__name__)

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Letters after which sums are scaled: each is 1e-7 at least, so they stay far above the least double.
STRETCH = 32
#: Cells of a table of pieces that are held at once, a word at least.
CELLS = 1 << 20
#: Words whose log probabilities a task remembers.
REMEMBERED = 200_000


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces in lower case, each once, without byte and control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    found = {model.id_to_piece(i).lower() for i in ids}
    return sorted(p for p in found if LETTERS.fullmatch(p.removeprefix(START) or "a"))


def runs(text: str | None) -> list[str]:
    """The lower-case runs of letters of a text, whole. Numbers that are no digits, such as a raised 2, part them too."""
    found = LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


class Lattice:
    """Cuts of words into pieces, for many words of one length at once.

    Piece 0 stands for no piece; piece 1 for any single character that the vocabulary lacks, so that
    every word can be cut.
    """

    def __init__(self, pieces: list[str]):
        self.ids = {p: i + 2 for i, p in enumerate(pieces)}
        self.size = len(pieces) + 2
        self.longest = max(map(len, pieces), default=1)

    def table(self, words: list[str]) -> np.ndarray:
        """Piece ids by word, end and length - 1, for words of one length (with the start mark)."""
        n, width = len(words[0]), min(self.longest, len(words[0]))
        get = self.ids.get
        flat = []
        for word in words:
            for end in range(1, n + 1):
                for length in range(1, width + 1):
                    flat.append(get(word[end - length : end], length == 1) if length <= end else 0)
        return np.array(flat, dtype=np.int64).reshape(len(words), n, width)

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``words``, their table), a length and a bounded number of words at a time."""
        by: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by.setdefault(len(word), []).append(i)
        for n, places in by.items():
            step = max(1, min(4096, CELLS // ((n + 1) * self.longest)))
            for at in range(0, len(places), step):
                part = places[at : at + step]
                yield np.array(part), self.table([START + words[i] for i in part])

    @staticmethod
    def forward(table: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[word, end, language] for p[piece, language], alpha[:, 0] being 1; and the logarithm of what each was divided by."""
        w, n, width = table.shape
        alpha, scale = np.zeros((w, n + 1, p.shape[1])), np.zeros((w, n + 1, p.shape[1]))
        alpha[:, 0] = 1.0
        for end in range(1, n + 1):
            scale[:, end] = scale[:, end - 1]
            for length in range(1, min(width, end) + 1):
                alpha[:, end] += alpha[:, end - length] * p[table[:, end - 1, length - 1]]
            if end % STRETCH == 0:
                # this sum and those that are still in use, in units of this one
                start, unit = max(0, end - width), alpha[:, end].copy()
                alpha[:, start : end + 1] /= unit[:, None]
                scale[:, start : end + 1] += np.log(unit)[:, None]
        return alpha, scale

    def log_probabilities(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), p.shape[1]))
        for places, table in self.groups(words):
            alpha, scale = self.forward(table, p)
            out[places] = np.log(alpha[:, -1]) + scale[:, -1]
        return out

    def expected(self, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in ``n`` occurrences of the words, for one language's p[piece].

        Sums before a place times sums behind it, over the sum of all cuts; those behind are sums before in the word read
        backwards.
        """
        counts = np.zeros(self.size)
        for places, table in self.groups(words):
            w, length, width = table.shape
            before, scale = self.forward(table, p[:, None])
            mirrored = np.zeros_like(table)
            for k in range(1, width + 1):
                # the piece of k letters that ends at a place ends k letters further on, seen from behind
                mirrored[:, k - 1 :, k - 1] = table[:, k - 1 :, k - 1][:, ::-1]
            behind, behind_scale = self.forward(mirrored, p[:, None])
            front = np.log(np.maximum(before, 1e-300))[:, :, 0] + scale[:, :, 0]
            back = (np.log(np.maximum(behind, 1e-300))[:, :, 0] + behind_scale[:, :, 0])[:, ::-1]
            for end in range(1, length + 1):
                for k in range(1, min(width, end) + 1):
                    ids = table[:, end - 1, k - 1]
                    np.add.at(counts, ids, n[places] * p[ids] * np.exp(np.minimum(front[:, end - k] + back[:, end] - front[:, -1], 700.0)))
        counts[0] = 0.0
        return counts


class Identifier:
    """Scores texts; remembers words."""

    def __init__(self, lattice: Lattice, languages: list[str], p: np.ndarray):
        self.lattice, self.languages, self.p = lattice, languages, p
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.values = np.zeros((0, len(self.languages)))

    def __getstate__(self):
        return {"lattice": self.lattice, "languages": self.languages, "p": self.p}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """Best language and posterior for each text; new words of all texts are scored together."""
        split = [runs(t) for t in texts]
        if len(self.places) > REMEMBERED:
            self.forget()
        new = sorted({w for ws in split for w in ws} - self.places.keys())
        if new:
            at = len(self.places)
            self.places.update((w, at + i) for i, w in enumerate(new))
            self.values = np.concatenate([self.values, self.lattice.log_probabilities(new, self.p)])
        names, scores = [], []
        for ws in split:
            if not ws or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.values[np.fromiter((self.places[w] for w in ws), dtype=np.int64, count=len(ws))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for text, lang in zip(batch["text"], batch["lang"]):
            counts.update((lang, w) for w in runs(text))
        if not counts:
            continue
        yield pd.DataFrame({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())})


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, out: int = 2, docs_per_language: int = 500, rounds: int = 2, path: str = VOCABULARY) -> Identifier:
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"), docs[lang].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("id"), folds) != out))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("of_lang")).withColumnRenamed("lang", "name")
    # by row: ids may be null, or the same, in all rows of a language
    draw = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id(), F.lit(9)), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.withColumn("draw", draw).join(F.broadcast(sizes), F.col("lang") == F.col("name"))  # a row per language
    rows = rows.where(F.col("draw") * F.col("of_lang") < docs_per_language).select("text", "lang")
    words = rows.mapInPandas(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(words, "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    lattice = Lattice(vocabulary(path))
    p = np.full((lattice.size, len(languages)), 1.0 / lattice.size)
    p[0], p[1] = 0.0, 1e-7
    place = {name: i for i, name in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        now = p

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, part in batch.groupby("lang"):
                    counts = lattice.expected(part["word"].tolist(), part["n"].to_numpy(dtype=float), now[:, place[name]])
                    some = np.flatnonzero(counts)
                    yield pd.DataFrame({"lang": name, "piece": some, "n": counts[some]})

        found = words.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(p)
        counts[found["piece"].to_numpy(), found["lang"].map(place).to_numpy()] = found["n"].to_numpy()
        # a share of the mean of all languages and of the uniform keeps every piece possible everywhere
        each = counts / np.maximum(counts.sum(axis=0), 1e-9)
        p = 0.98 * each + 0.015 * each.mean(axis=1, keepdims=True) + 0.005 / lattice.size
        p[0], p[1] = 0.0, 1e-7
    return Identifier(lattice, languages, p)


def identified(docs: DataFrame, identifier: Identifier, text: str = "text") -> DataFrame:
    """All columns of the table, ``lang_pred`` and ``score``."""
    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, scores = identifier.predict(texts)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found = docs.withColumn("identified", of(docs[text]))
    return found.select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "identified.lang_pred", "identified.score")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, out: int = 2, **how) -> DataFrame:
    """``id, held_out, lang_pred, score`` for every document; rows whose remainder is ``out`` teach nothing."""
    identifier = fit(docs, id, text, lang, folds, out, **how)
    rows = identified(docs.select(docs[id].alias("id"), docs[text].alias("text")), identifier)
    return rows.select("id", (remainder(F.col("id"), folds) == out).alias("held_out"), "lang_pred", "score")

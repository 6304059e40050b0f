"""Runs of words that repeat with a period: seed and extend along diagonals.

A run is a stretch of words in which words a period apart are the same, that no neighbouring word extends.
A run of ``EXPONENT`` periods or more matches itself, one period on, over three periods at least. So for the
periods from ``low`` to ``2 * low - 1``, every run holds ``3 * low`` words in a row that occur again a period
later: these k-grams are the seeds. They are longer than any period of their class, and a k-gram that came
again sooner would make the period smaller. It is therefore enough to pair each occurrence with the next one in
its document: a seed lies on the diagonal of its lag, there are at most as many seeds as words in a class, and the
classes double. Of the seeds of one lag, a table of how far that lag is covered lets only the first of a run
be extended.

The k-grams are told apart exactly, by numbering pairs of numbered halves; those that occur once in their document
are put aside at every doubling, so ordinary text is done after three or four.

A document is worked on by itself, within the task that reads it: nothing is shuffled, and a group of copies or a
frequent word costs no more than other text. Texts of any length are taken whole, in memory in proportion to their
words. Null, empty and blank texts have no words and no runs. Repeated rows, and null or repeated ids, each
give a row of their own. Other columns are left out, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from plumbline.llm.common import shipped

#: The least number of periods in a run. The seeds hold for four or more.
EXPONENT = 4
MIN_LENGTH = 6
#: Words that are worked on at once; a longer text makes a batch by itself.
BATCH_WORDS = 1 << 17

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
FOUND = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])

shipped(__name__)


def repeated_grams(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of the grams made of ``first[i]`` and ``second[i + shift]``; -1 where a gram occurs once."""
    at = np.flatnonzero(first[: max(0, len(first) - shift)] >= 0)
    at = at[second[at + shift] >= 0]
    made = np.full(len(first), -1)
    if len(at):
        _, number, times = np.unique(first[at] * (second.max() + 1) + second[at + shift], return_inverse=True, return_counts=True)
        made[at] = np.where(times[number] > 1, number, -1)
    return made


def seeds(grams: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """``at, lag``: occurrences whose next occurrence is ``low`` to ``2 * low - 1`` words on, by place."""
    at = np.flatnonzero(grams >= 0)
    at = at[np.argsort(grams[at], kind="stable")]
    lag = at[1:] - at[:-1]
    near = (grams[at[1:]] == grams[at[:-1]]) & (lag >= low) & (lag < 2 * low)
    at, lag = at[:-1][near], lag[near]
    order = np.argsort(at)
    return at[order], lag[order]


def matched(words: np.ndarray, end: int, lag: int) -> int:
    """How far words match those ``lag`` on, from ``end``."""
    block = 64
    while end + lag < len(words):
        block = min(2 * block, len(words) - lag - end)
        unlike = np.flatnonzero(words[end : end + block] != words[end + lag : end + lag + block])
        if len(unlike):
            return end + int(unlike[0])
        end += block
    return end


def runs_in(words: np.ndarray, min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs in numbered words; documents must not share numbers."""
    _, number, times = np.unique(words, return_inverse=True, return_counts=True)
    grams, low, found = np.where(times[number] > 1, number, -1), 1, []
    while (grams >= 0).any():
        double = repeated_grams(grams, grams, low)
        covered: dict[int, int] = {}
        for at, lag in zip(*(x.tolist() for x in seeds(repeated_grams(double, grams, 2 * low), low))):
            if at >= covered.get(lag, 0):
                covered[lag] = end = matched(words, at + 3 * low, lag)
                if end - at + lag >= max(min_length, exponent * lag):
                    found.append((at, end - at + lag, lag))
        grams, low = double, 2 * low
    return sorted(found)


def batches(texts: Iterable[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, as many texts at once as hold ``BATCH_WORDS``, one at least."""
    held, size = [], 0
    for text in texts:
        # split() of bytes knows the blanks 0x20 and 0x09 to 0x0D only
        held.append((text or b"").split())
        size += len(held[-1])
        if size >= BATCH_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def found_in(texts: Iterable[bytes | None], min_length: int, exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """``n_words, runs, collapsed`` of each text, in batches of documents."""
    for split in batches(texts):
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        ends = np.cumsum(sizes)
        codes = pd.factorize(np.array([w for words in split for w in words] or [b""], dtype=object))[0][: ends[-1]].astype(np.int64)
        codes += np.repeat(np.arange(len(split)), sizes) * (codes.max(initial=0) + 1)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
        for start, length, period in runs_in(codes, min_length, exponent):
            d = int(np.searchsorted(ends, start, side="right"))
            runs[d].append((start - int(ends[d] - sizes[d]), length, period))
        for words, inside in zip(split, runs):
            n = len(words)
            if inside:
                drop = np.zeros(n, dtype=bool)
                for start, length, period in inside:
                    drop[start + period : start + length] = True
                words = [w for w, gone in zip(words, drop.tolist()) if not gone]
            yield n, inside, b" ".join(words)


def finder(min_length: int = MIN_LENGTH, exponent: int = EXPONENT):
    if exponent < EXPONENT:
        raise ValueError(f"runs of fewer than {EXPONENT} periods have no seeds of this length")

    @F.arrow_udf(FOUND)
    def find(text: pa.Array) -> pa.Array:
        sizes, runs, collapsed = zip(*found_in((t.as_py() for t in text.cast(pa.binary())), min_length, exponent)) if len(text) else ((), (), ())
        offsets = np.cumsum([0, *map(len, runs)])
        flat = np.array([r for inside in runs for r in inside], dtype=np.int64).reshape(-1, 3)
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return find


def find_runs(df: DataFrame, id: str = "doc_id", text: str | Column = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``id, n_words, runs, collapsed``: all runs by start, then period, and the words without repetitions.

    A run is at least ``min_length`` words and ``exponent`` of its smallest period long. ``collapsed`` joins by
    single spaces the words that no run contains after its first period.
    """
    text = df[text] if isinstance(text, str) else text
    found = df.select(df[id].alias("id"), finder(min_length, exponent)(text).alias("found"))
    return found.select("id", "found.n_words", "found.runs", "found.collapsed")

"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts are cut to words; a fingerprint is the hash of ``GRAM`` words in a row, and of
``WINDOW`` fingerprints in a row the least are kept. So a template and a text that share GRAM + WINDOW - 1
words in a row share a kept fingerprint. The inverted index has the template positions of each kept
fingerprint; it grows with the templates alone and goes to the tasks. Hits of a text on nearby diagonals
are one candidate, which is aligned with its template in a band around them; hits before and after the
words aligned are candidates again. A match reports the share of
the template's words that the alignment covers, and its span in words and characters.

Of matches that overlap in a text, the one with most matched words is reported; a template that occurs
several times in a text is reported each time. A null or empty text has no match. Templates without words
match nothing; of equal templates the first by name is reported. Texts are read whole, of any length; repeated rows are reported alike.
An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from plumbline.llm.common import shipped

shipped(__name__)

GRAM, WINDOW, BAND = 3, 3, 8
WORD = re.compile(r"[^\W_]+")
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

# Notices by which works are commonly licensed. The licenses' own texts, or the notices that they ask to be put
# at the head of a file, lie beside this in files named like the licenses, and are templates ending in ``-text``.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-opening": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files, to deal in the Software without restriction"
    ),
}
TEXTS = {file.stem + "-text": file.read_text(encoding="utf-8") for file in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
TEMPLATES = NOTICES | TEXTS


def fingerprints(words: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept fingerprints of word hashes; ``breaks`` are where texts begin.

    A window that reaches over the end of a text is cut there, so short texts keep their least too.
    """
    n = len(words) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = words[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, GRAM):
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k]
        hashes ^= hashes >> np.uint64(29)
    for k in range(1, GRAM):  # no gram reaches over a text's end
        over = breaks - k
        hashes[over[(over >= 0) & (over < n)]] = NONE
    kept = np.zeros(n, dtype=bool)
    padded = np.concatenate([np.full(WINDOW - 1, NONE), hashes, np.full(WINDOW - 1, NONE)])
    for first in range(WINDOW):  # the window whose place ``first`` this gram has
        window = np.minimum.reduce([padded[WINDOW - 1 - first + k : WINDOW - 1 - first + k + n] for k in range(WINDOW)])
        kept |= hashes == window
    kept &= hashes != NONE
    at = np.flatnonzero(kept)
    return at, hashes[at]


def align(template: list[str], words: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment with word j of the template near word
    j + shift of ``words``; a match gains 2, a gap or mismatch costs 1."""
    best = (0, 0, 0, 0)
    width = 2 * band + 1
    row = [(0, 0, -1)] * (width + 1)  # score, matches, first word, by diagonal
    for j, word in enumerate(template):
        ahead = [(0, 0, -1)] * (width + 1)
        for d in range(width):
            i = j + shift + d - band
            if not 0 <= i < len(words):
                continue
            score, hits, first = row[d]
            if words[i] == word:
                option = (score + 2, hits + 1, first if score > 0 else i)
            else:
                option = (score - 1, hits, first)
            skip_template, skip_word = row[d + 1], ahead[d - 1] if d else (0, 0, -1)
            for score, hits, first in (skip_template, skip_word):
                if score - 1 > option[0]:
                    option = (score - 1, hits, first)
            if option[0] > 0:
                ahead[d] = option
                if (option[0], option[1]) > best[:2]:
                    best = (option[0], option[1], option[2], i + 1)
        row = ahead
    return best[1], best[2], best[3]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.names = sorted(templates)
        self.words = [WORD.findall(templates[n].lower()) for n in self.names]
        self.least = least
        postings: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for at, h in zip(*fingerprints(self.hashes(words, {}), np.zeros(0, dtype=np.int64))):
                postings.setdefault(int(h), []).append((t, int(at)))
        self.postings = postings
        self.index = np.array(sorted(postings), dtype=np.uint64)

    @staticmethod
    def hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        for w in set(words) - known.keys():
            known[w] = digest(w)
        return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))

    def scan(self, texts: list[str | None]) -> list[tuple[int, str, int, int, float, int, int, int, int]]:
        """(text, license, matched, length, coverage, first and end word, first and end character)."""
        split = [WORD.findall((t or "").lower()) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        at, h = fingerprints(self.hashes([w for ws in split for w in ws], {}), starts)
        if not len(self.index) or not len(at):
            return []
        hit = np.isin(h, self.index)
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for place, key in zip(at[hit].tolist(), h[hit].tolist()):
            text = int(np.searchsorted(starts, place, side="right")) - 1
            place -= int(starts[text])
            for t, offset in self.postings[key]:
                by.setdefault((text, t), []).append((place, place - offset))
        out, spans_of = [], {}
        for (text, t), hits in sorted(by.items()):
            for matched, first, end in self._occurrences(self.words[t], split[text], sorted(hits)):
                if text not in spans_of:
                    # positions in the text itself: lower() may change the length
                    spans = [m.span() for m in WORD.finditer(texts[text])]
                    if len(spans) != len(split[text]):
                        spans = [m.span() for m in WORD.finditer(texts[text].lower())]
                    spans_of = {text: spans}
                spans, length = spans_of[text], len(self.words[t])
                out.append((text, self.names[t], matched, length, matched / length, first, end, spans[first][0], spans[end - 1][1]))
        return self._best(out)

    def _occurrences(self, template: list[str], words: list[str], hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(matched, first, end) of the template's occurrences, from its hits (place, diagonal) by place.

        What lies before and after an occurrence is searched by itself, so none hides another.
        """
        places = [place for place, _ in hits]
        least = max(1, self.least * len(template))
        open_ = [(0, len(words), 0, len(hits))]  # words and hits still to be searched
        while open_:
            low, high, i, j = open_.pop()
            failed = None
            while i < j and high - low >= least:
                place, diagonal = hits[i]
                if failed is not None and failed <= diagonal < failed + BAND:  # within the band of a candidate that is none
                    i += 1
                    continue
                ahead = bisect_left(places, place + len(template), i, j)
                lowest = min(d for _, d in hits[i:ahead] if d > diagonal - BAND)
                begin = max(low, lowest - BAND)
                part = words[begin : min(high, lowest + len(template) + 2 * BAND)]
                matched, first, end = align(template, part, lowest + BAND // 2 - begin)
                if matched < least:
                    failed, i = lowest, i + 1
                    continue
                first, end = first + begin, end + begin
                yield matched, first, end
                open_.append((end, high, bisect_left(places, end, i, j), j))
                high, j = first, bisect_left(places, first - GRAM + 1, i, j)

    @staticmethod
    def _best(found: list[tuple]) -> list[tuple]:
        """Of matches of a text whose words overlap, the one with most matched words (then coverage, then
        the shorter span, then the name): a notice that contains a shorter one is reported as itself."""
        kept: dict[int, list[tuple[int, int, tuple]]] = {}
        for match in sorted(found, key=lambda m: (m[0], -m[2], -m[4], m[6] - m[5], m[1])):
            others = kept.setdefault(match[0], [])
            at = bisect_left(others, (match[5],))
            if (at == 0 or others[at - 1][1] <= match[5]) and (at == len(others) or match[6] <= others[at][0]):
                others.insert(at, (match[5], match[6], match))
        return [m for text in sorted(kept) for _, _, m in kept[text]]


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = 0.7) -> DataFrame:
    """A row for each occurrence of a template of which at least ``least`` is covered."""
    scanner = Scanner(TEMPLATES if templates is None else templates, least)
    kind = docs.schema[id].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = scanner.scan(part.column("text").to_pylist())
                if found:
                    columns = list(zip(*found))
                    arrays = [part.column("id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string())]
                    arrays += [pa.array(columns[k], pa.float64() if k == 4 else pa.int64()) for k in range(2, 9)]
                    names = ["id", "license", "matched", "template_words", "coverage", "first_word", "end_word", "first_char", "end_char"]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"id {kind}, license string, matched long, template_words long, coverage double, first_word long, end_word long, first_char long, end_char long"
    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(search, schema)

"""Whole license texts with worn words: banded alignment against a full one."""

import random

import pytest

from plumbline.llm import license_scan

FILLER = [f"w{i}" for i in range(500)]


def full_alignment(template, words):
    """Matched words of the best local alignment over all diagonals: score, then matches."""
    best, row = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        ahead = [(0, 0)]
        for i, w in enumerate(words, 1):
            score, hits = row[i - 1]
            options = [(0, 0), (score + 2, hits + 1) if t == w else (score - 1, hits), (row[i][0] - 1, row[i][1]), (ahead[-1][0] - 1, ahead[-1][1])]
            ahead.append(max(options))
            best = max(best, ahead[-1])
        row = ahead
    return best[1]


def worn(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [words[at], "new"], ["other"]])
    return words


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner(license_scan.TEMPLATES, 0.7)


@pytest.mark.parametrize("name", sorted(license_scan.TEXTS))
def test_worn_texts_against_full_alignment(scanner, name):
    rng = random.Random(name)
    words = license_scan.WORD.findall(license_scan.TEXTS[name].lower())
    for edits in (0, len(words) // 40, len(words) // 15):
        inside = worn(rng, words, edits)
        before, after = [[rng.choice(FILLER) for _ in range(rng.randrange(80))] for _ in range(2)]
        text = [*before, *inside, *after]
        (found,) = [m for m in scanner.scan([" ".join(text)]) if m[2] > len(words) // 2]
        assert found[1] == name
        assert found[2] == full_alignment(words, text)
        # the span begins and ends within the few words that were changed there
        assert abs(found[5] - len(before)) <= 4 and abs(found[6] - len(before) - len(inside)) <= 4


def test_related_licenses_are_told_apart(scanner):
    for name, text in license_scan.TEXTS.items():
        shown = f"Some words before it. {text} And some after."
        (match,) = scanner.scan([shown])
        assert (match[1], match[4]) == (name, 1.0)
        first, end = text.strip()[:12], text.strip().rstrip(".>/")[-12:]
        assert shown[match[7] :].startswith(first.lstrip()) and shown[: match[8]].rstrip(".>/").endswith(end.rstrip(".>/"))

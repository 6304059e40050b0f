"""Rules written as plain sentences, such as ``The 'age' column should be between 1 and 9``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from plumbline.operators.rules import BETWEEN, GREATER, LESS, NOT_NULL, Rule, not_empty

#: What every sentence says: a column, and a demand on it.
STATEMENT = re.compile(r"the '(?P<column>.+)' column should (?P<demand>.+)", re.IGNORECASE)


def _settings(kind: str, *names: str):
    """A maker of one rule whose settings are the numbers of the demand, in this order."""
    return lambda rule_id, column, numbers: [Rule(rule_id, kind, {"column": column, **dict(zip(names, map(int, numbers)))})]


# The demands understood, each with what it asks for.
DEMANDS = [
    (r"not be null", _settings(NOT_NULL)),
    (r"not be empty", lambda rule_id, column, _: not_empty(rule_id, column)),
    (r"be less than (\d+)", _settings(LESS, "value")),
    (r"be greater than (\d+)", _settings(GREATER, "value")),
    (r"be between (\d+) and (\d+)", _settings(BETWEEN, "min_value", "max_value")),
]


def sentence_rules(sentences: Iterable[str]) -> list[Rule]:
    """The rules the sentences state, in any case; a sentence that states none is left out. Column names are in lower case."""
    rules = []
    for number, sentence in enumerate(sentences, 1):
        statement = STATEMENT.search(sentence)
        for demand, make in DEMANDS if statement else ():
            if asked := re.match(demand, statement["demand"], re.IGNORECASE):
                rules += make(f"sentence_{number}", statement["column"].lower(), asked.groups())
    return rules

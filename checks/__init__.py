"""Every operator as a query on the given tables, beside the same question in SQL."""

from checks import cleaning, drift, profiles, quality, rules, shapes, sources, states  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

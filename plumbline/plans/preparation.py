"""Prepare a table for analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.filling import impute_median, impute_mode, normalize, standardize_types


def preprocess(df: DataFrame) -> DataFrame:
    """Fill gaps (numbers by median, text by mode), scale the numbers, then settle the types."""
    return standardize_types(normalize(impute_mode(impute_median(df))))

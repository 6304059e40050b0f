"""What stands out among the columns of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.correlation import high_correlations, high_variance
from plumbline.operators.frequencies import category_statistics


def column_insights(df: DataFrame) -> dict[str, DataFrame]:
    """``high_correlations``, ``high_variance_columns`` and ``categorical_statistics``."""
    return {
        "high_correlations": high_correlations(df),
        "high_variance_columns": high_variance(df),
        "categorical_statistics": category_statistics(df),
    }

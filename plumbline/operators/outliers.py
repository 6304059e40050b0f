"""Rows far from a column's mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import numeric_columns, value

# Deviations from the mean that make a row an anomaly, and an extreme one.
ANOMALY_AT = 3
EXTREME_AT = 5


def detect_anomalies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``_is_anomaly, _anomaly_score, _zscore, _is_extreme`` for each numeric column named.

    With no spread the scores are NULL and the flags false. Means and deviations come in as one
    scalar subquery, so the rows themselves are read once and not moved.
    """
    names = numeric_columns(df, columns)
    if not names:
        return df
    x = {n: value(df, n).cast("double") for n in names}
    parts = [F.struct(F.avg(x[n]).alias("mean"), F.stddev_samp(x[n]).alias("std")).alias(n) for n in names]
    stats = df.agg(F.struct(*parts).alias("s")).scalar()
    added = {}
    for n in names:
        mean, std = stats[n]["mean"], stats[n]["std"]
        gap = F.abs(x[n] - mean)
        zscore = F.try_divide(x[n] - mean, std)
        added[f"{n}_is_anomaly"] = F.coalesce(gap > std * ANOMALY_AT, F.lit(False))
        added[f"{n}_anomaly_score"] = F.try_divide(gap, std * ANOMALY_AT)
        added[f"{n}_zscore"] = zscore
        added[f"{n}_is_extreme"] = F.coalesce(F.abs(zscore) > EXTREME_AT, F.lit(False))
    return df.withColumns(added)

"""Pearson correlation between numeric columns, and variance outliers among them.

Correlations of n columns are n * n / 2 sums. Written as aggregates they outgrow generated code, and dealing
every row to its pairs of columns makes n * n / 2 rows of each. As matrix products they are one multiplication of a batch
of rows, so this is the one place outside the training-text folder that runs numpy in the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import numeric_columns, one_row_each, stack, value

STRONG = 0.7
#: Share of a sum of squares below which what is left of it is rounding.
LOST = 1e-11
SUMS = ("n", "x", "y", "xx", "yy", "xy")
SCHEMA = "column1 string, column2 string, correlation double"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The values of a batch, NaN for none."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)


def _values(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[value(df, name).cast("double").alias(f"c{k}") for k, name in enumerate(names)])


def _extents(df: DataFrame, names: list[str]) -> list[tuple[float, bool]]:
    """The mean of each column and whether it varies: a row per column reaches the driver."""
    matrix, width = _matrix, len(names)

    def extents(batches):
        n, total, low, high = np.zeros(width), np.zeros(width), np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                there = ~np.isnan(x)
                n, total = n + there.sum(axis=0), total + np.where(there, x, 0.0).sum(axis=0)
                low, high = np.fmin(low, np.fmin.reduce(x)), np.fmax(high, np.fmax.reduce(x))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(width, dtype=np.int32), n, total, low, high)], ["i", "n", "total", "low", "high"])

    found = _values(df, names).mapInArrow(extents, "i int, n double, total double, low double, high double").groupBy("i")
    found = found.agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), (F.max("high") > F.min("low")).alias("varies")).collect()
    of = {r["i"]: r for r in found}
    return [(of[i]["mean"] if i in of and np.isfinite(of[i]["mean"] or 0.0) else None, i in of and of[i]["varies"]) for i in range(width)]


def _sums(df: DataFrame, names: list[str], means: list[float]) -> DataFrame:
    """``i, j`` and the sums of the two columns, of their squares and products over the rows that have both, a row per task and pair.

    Every task adds up matrix products of its batches: the values against the presence of the others. Values enter as
    distances from the columns' means, so that no digits are lost when the sums are added up.
    """
    matrix = _matrix

    def summed(batches):
        total = None
        for batch in batches:
            x = matrix(batch)
            there = ~np.isnan(x)
            x = np.where(there, x - np.array(means), 0.0)
            here = there.astype(float)
            sums = np.stack([here.T @ here, x.T @ here, here.T @ x, (x * x).T @ here, here.T @ (x * x), x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            i, j = np.triu_indices(len(means), 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i.astype(np.int32), j.astype(np.int32), *total[:, i, j])], ["i", "j", *SUMS])

    return _values(df, names).mapInArrow(summed, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))


def _pairs(df: DataFrame, names: list[str], means: list[float | None]) -> DataFrame:
    """Each pair once, in column order.

    NULL (not an error) where either column is constant among the rows that have both, or there are none. A column
    counts as constant there if its spread is lost in the digits of its distance from the mean of all rows.
    """
    n, x, y, xx, yy, xy = (F.sum(s) for s in SUMS)
    spread_x, spread_y = xx - x * x / n, yy - y * y / n
    varies = (spread_x > LOST * xx) & (spread_y > LOST * yy)
    pearson = F.when(varies, (xy - x * y / n) / F.sqrt(spread_x) / F.sqrt(spread_y))
    summed = _sums(df, names, [m or 0.0 for m in means]).groupBy("i", "j").agg(F.when(n > 0, pearson).alias("correlation"))
    pairs = [(i, j, names[i], names[j]) for i, j in combinations(range(len(names)), 2)]
    named = df.sparkSession.createDataFrame(pairs, "i int, j int, column1 string, column2 string")
    return named.join(F.broadcast(summed), ["i", "j"], "left").select("column1", "column2", "correlation")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column1, column2, correlation``: the full matrix in long form, pairwise complete.

    Two scans however many columns there are: that for the means runs when the frame is built.
    """
    names = numeric_columns(df, columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], SCHEMA)
    extents = _extents(df, names)
    both_ways = _pairs(df, names, [mean for mean, _ in extents]).select(
        F.inline(
            F.array(
                F.struct("column1", "column2", "correlation"),
                F.struct(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "correlation"),
            )
        )
    )
    itself = [(n, n, 1.0 if varies else None) for n, (_, varies) in zip(names, extents)]
    return both_ways.union(df.sparkSession.createDataFrame(itself, SCHEMA))


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None, above: float = STRONG) -> DataFrame:
    """Each pair of columns once, in column order, whose correlation is stronger than ``above``."""
    names = numeric_columns(df, columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return _pairs(df, names, [mean for mean, _ in _extents(df, names)]).where(F.abs("correlation") > above)


def high_variance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, variance`` above the mean variance of all numeric columns plus one deviation."""
    names = numeric_columns(df, columns)
    cells = [F.struct(F.lit(n), F.var_samp(value(df, n).cast("double"))) for n in names]
    variances = one_row_each(df, cells, "column string, variance double")
    limit = variances.agg((F.avg("variance") + F.stddev_samp("variance")).alias("limit")).scalar()
    return variances.where(F.col("variance") > limit)

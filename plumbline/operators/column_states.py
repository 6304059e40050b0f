"""Column states that can be stored and merged: a profile of many partitions without a new scan of the old ones.

A state is a row per column: counts, moments, extremes, a sketch of the distinct values, a sketch of the
quantiles, and the most frequent values with what may be missing from their counts. Merging the states of two
parts gives a state of the whole, in any order and any number of times. Counts, mean, deviation and extremes are exact
(up to the last digits of a double). The number of distinct values is within ``UNIQUE_ERROR`` of the exact one, a
quantile's rank within ``RANK_ERROR`` of the rank asked for (both hold for over 99 of 100 states). A frequent value carries a
lower and an upper bound of its count, which are equal as long as no part had more values than a state keeps.

A state has a bounded size however many rows it is of, except that the frequent values of text hold
texts: those over 64 bytes are known by their first characters and their digest, as in :func:`columns.bounded`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import percent
from plumbline.operators.columns import bounded, numeric_columns, one_row_each, pick, stack, value
from plumbline.operators.frequencies import kind_counts

#: Frequent values that a state keeps of a column.
HEAVY = 200
#: Sizes of the sketches: 2 ** 12 registers, and the retained items of a level.
REGISTERS = 12
RETAINED = 400
UNIQUE_ERROR = 0.05
RANK_ERROR = 0.02

COUNTED = "column string, rows bigint, nulls bigint, numbers bigint, mean double, m2 double, least double, greatest double, kinds binary, quantiles binary"
STATE = f"{COUNTED}, type string, heavy array<struct<value: string, count: bigint, at_most: bigint>>, left_out bigint"


def column_states(df: DataFrame, columns: Sequence[str] | None = None, heavy: int = HEAVY) -> DataFrame:
    """The state of each column, see ``STATE``. An empty table has states of no rows."""
    names, numbers, types = pick(df, columns), set(numeric_columns(df)), dict(df.dtypes)
    rows = []
    for name in names:
        x = value(df, name).cast("double") if name in numbers else F.lit(None).cast("double")
        key = bounded(df, name)
        rows.append(
            F.struct(
                F.lit(name),
                F.count(F.lit(1)),
                F.count_if(key.isNull()),
                F.count(x),
                F.avg(x),
                F.var_pop(x) * F.count(x),
                F.min(x),
                F.max(x),
                F.hll_sketch_agg(F.when(key.isNotNull(), F.xxhash64(key)), F.lit(REGISTERS)),
                F.kll_sketch_agg_double(x, F.lit(RETAINED)),
            )
        )
    counted = one_row_each(df, rows, COUNTED, 8)
    frequent = []
    for name in names:
        groups = kind_counts(df, name).where("value IS NOT NULL").select(F.col("value").cast("string").alias("value"), "n")
        first = groups.orderBy(F.col("n").desc(), "value").limit(heavy + 1)
        listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value")))
        frequent.append(first.agg(listed.alias("listed")).select(F.lit(name).alias("column"), F.lit(types[name]).alias("type"), "listed"))
    kept = F.transform(F.slice("listed", 1, heavy), lambda v: F.struct(v["value"].alias("value"), (-v["less"]).alias("count"), (-v["less"]).alias("at_most")))
    left_out = F.coalesce(-F.get("listed", F.lit(heavy))["less"], F.lit(0))
    found = stack(frequent).select("column", "type", kept.alias("heavy"), left_out.cast("bigint").alias("left_out"))
    return counted.join(F.broadcast(found), "column").select(*_fields())


def _fields() -> list[str]:
    return [field.strip().split(" ")[0] for field in STATE.split("array<")[0].split(", ")] + ["left_out"]


def merge_states(states: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One state per column of the states of parts. Only sketches and lists are moved, a row per column and task."""
    n, weight = F.col("numbers"), F.sum("numbers")
    means = states.groupBy("column").agg(F.try_divide(F.sum(F.col("mean") * n), weight).alias("mean_of_all"), F.sum("left_out").alias("left_out_of_all"))
    # a row per column: bounded by the width of the table
    around = states.join(F.broadcast(means), "column")
    apart = F.col("mean") - F.col("mean_of_all")
    counted = around.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls", "numbers")],
        F.first("mean_of_all").alias("mean"),
        F.sum(F.col("m2") + n * apart * apart).alias("m2"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.hll_union_agg("kinds").alias("kinds"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.when(F.min("type") == F.max("type"), F.min("type")).alias("type"),
        F.first("left_out_of_all").alias("left_out_of_all"),
    )
    # a value that a part does not list may still be there as often as the most frequent one it left out
    listed = around.select("column", "left_out", "left_out_of_all", F.inline("heavy")).groupBy("column", "left_out_of_all", "value")
    listed = listed.agg(F.sum("count").alias("count"), (F.sum("at_most") + F.col("left_out_of_all") - F.sum("left_out")).alias("at_most"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("count").desc(), "value"))
    first = listed.withColumn("place", place).where(F.col("place") <= heavy + 1).groupBy("column")
    entry = F.when(F.col("place") <= heavy, F.struct("place", "value", "count", "at_most"))
    first = first.agg(F.array_sort(F.collect_list(entry)).alias("listed"), F.max(F.when(F.col("place") > heavy, F.col("count"))).alias("next"))
    kept = F.transform("listed", lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"), v["at_most"].alias("at_most")))
    joined = counted.join(F.broadcast(first), "column", "left")
    none = F.array().cast("array<struct<value: string, count: bigint, at_most: bigint>>")
    return joined.withColumns({"heavy": F.coalesce(kept, none), "left_out": F.col("left_out_of_all") + F.coalesce("next", F.lit(0))}).select(*_fields())


def state_profile(states: DataFrame) -> DataFrame:
    """``column, type, rows, nulls, null_percentage, unique_estimate, mean, std, min, max, q25, q50, q75`` of states."""
    n = F.col("numbers")
    quantiles = F.when(n > 0, F.kll_sketch_get_quantile_double("quantiles", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return states.withColumn("q", quantiles).select(
        "column",
        "type",
        "rows",
        "nulls",
        percent(F.col("nulls"), F.col("rows")).alias("null_percentage"),
        F.hll_sketch_estimate("kinds").alias("unique_estimate"),
        "mean",
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"),
        F.col("least").alias("min"),
        F.col("greatest").alias("max"),
        *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))],
    )


def state_top_values(states: DataFrame, k: int = 10) -> DataFrame:
    """``column, rank, value, count, at_most, exact``: the most frequent values that the states know.

    ``exact``: the count is, and no value left out can be as frequent.
    """
    listed = states.select("column", "left_out", F.posexplode(F.slice("heavy", 1, k)).alias("at", "v"))
    exact = (F.col("v.count") == F.col("v.at_most")) & (F.col("v.count") > F.col("left_out"))
    return listed.select("column", (F.col("at") + 1).alias("rank"), "v.value", "v.count", "v.at_most", exact.alias("exact"))

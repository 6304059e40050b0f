"""Queries of stored and merged column states, and of estimates held to their bounds."""

from datetime import date

from pyspark.sql import functions as F

from checks.registry import COLUMNS, GAPPY, LINEITEM_NUMBERS, each, gappy_orders, query, rounded, table
from plumbline.operators import column_states, frequencies, quantiles
from plumbline.operators.columns import one_row_each, pick, value
from plumbline.session import scratch_path
from plumbline.sources import history

ORDERS, NUMBERS = COLUMNS["orders"], ["o_orderkey", "o_custkey", "o_totalprice"]
TOP = 10


def _merged(spark, sf_dir):
    """Orders kept as the states of two days, one of them stored twice, and merged; others are kept beside them."""
    path, orders = scratch_path(spark, "states"), gappy_orders(spark, sf_dir)
    halves = [orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 3 <> 0")]
    for day, rows in ((1, halves[1]), (1, halves[0]), (2, halves[1]), (3, orders)):
        history.store_states(column_states.column_states(rows), path, "orders", date(2024, 1, day))
    history.store_states(column_states.column_states(orders), path, "others", date(2024, 1, 1))
    return orders, history.merged_states(spark, path, "orders", last=date(2024, 1, 2))


def _near_distinct(df, estimates, error, columns=None):
    """``column, near``: whether estimated distinct counts are within their bound of the exact ones."""
    exact = frequencies.distinct_counts(df, columns).select("column", F.col("distinct").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.ceil(error * F.col("exact"))
    return exact.join(F.broadcast(estimates), "column").select("column", near.alias("near"))


def _near_ranks(df, estimates, error, columns=None):
    """``column, near``: whether the estimated quartiles lie within their bound of the ranks asked for."""
    at = estimates.agg(F.map_from_entries(F.collect_list(F.struct("column", F.array("q25", "q50", "q75"))))).scalar()
    rows = []
    for name in columns:
        x = value(df, name).cast("double")
        holds = F.lit(True)
        for i, q in enumerate((0.25, 0.5, 0.75)):
            cut = at[name][i]
            holds &= (F.count_if(x < cut) <= (q + error) * F.count(x) + 1) & (F.count_if(x <= cut) >= (q - error) * F.count(x) - 1)
        rows.append(F.struct(F.lit(name), holds))
    return one_row_each(df, rows, "column string, near boolean", 2)


def _stats(c):
    if c not in NUMBERS:
        return 'NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS "min", NULL::DOUBLE AS "max", NULL::BOOLEAN AS quartiles_near'
    return f"""round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max", TRUE AS quartiles_near"""


_TYPES = dict(zip(ORDERS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"], strict=True))


@query(
    "merged_states",
    each(
        ORDERS,
        lambda c: f"""SELECT '{c}' AS "column", '{_TYPES[c]}' AS type, count(*) AS "rows", count(*) - count({c}) AS nulls,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percentage, TRUE AS unique_near, {_stats(c)} FROM {GAPPY}""",
    ),
)
def merged_states(spark, sf_dir):
    """The profile of two days' states equals that of all rows; estimates are within their bounds."""
    orders, states = _merged(spark, sf_dir)
    profile = column_states.state_profile(states)
    unique = _near_distinct(orders, profile.select("column", F.col("unique_estimate").alias("estimate")), column_states.UNIQUE_ERROR)
    ranks = _near_ranks(orders, profile.where("q50 IS NOT NULL"), column_states.RANK_ERROR, NUMBERS)
    for part, name in ((unique, "unique_near"), (ranks, "quartiles_near")):
        profile = profile.join(F.broadcast(part.withColumnRenamed("near", name)), "column", "left")
    return rounded(profile.drop("unique_estimate", "q25", "q50", "q75"), ["mean", "std"], 4)


@query(
    "merged_top_values",
    each(
        ["o_orderstatus", "o_orderpriority"],
        lambda c: f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS "rank", {c} AS value,
        count(*) AS "count", count(*) AS at_most, TRUE AS exact FROM {GAPPY} WHERE {c} IS NOT NULL GROUP BY {c}""",
    ),
)
def merged_top_values(spark, sf_dir):
    _, states = _merged(spark, sf_dir)
    return column_states.state_top_values(states.where("column IN ('o_orderstatus', 'o_orderpriority')"), TOP)


@query("unique_approx_bounds", each(COLUMNS["lineitem"], lambda c: f"""SELECT '{c}' AS "column", count({c}) >= 0 AS near FROM lineitem"""))
def unique_approx_bounds(spark, sf_dir):
    """Three deviations of the estimate, of two per cent each."""
    lineitem = table(spark, sf_dir, "lineitem")
    return _near_distinct(lineitem, frequencies.unique_approx(lineitem, rsd=0.02).withColumnRenamed("unique_approx", "estimate"), 0.06)


@query("quartiles_approx_bounds", each(LINEITEM_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", count({c}) >= 0 AS near FROM lineitem"""))
def quartiles_approx_bounds(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return _near_ranks(lineitem, quantiles.quartiles_approx(lineitem), 0.0002, pick(lineitem, LINEITEM_NUMBERS))

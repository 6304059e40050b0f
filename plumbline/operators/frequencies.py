"""Value frequencies and everything read off them: distinct counts, top values, samples, entropy.

Each column is grouped on its own, in its own type, straight off a scan that reads only that column.
Against one unpivoted table of (column, value) this keeps a low-cardinality column's groups from
sharing a hash map with a near-unique one, turns values into text after grouping instead of before,
and shuffles typed keys. Grouping combines on the map side, so a value that fills a third of the rows
travels once per task.

Long texts are counted by a short key (``columns.bounded``). Where a result shows some of them, such as the most
frequent or the smallest, the keys are ranked first and the texts of those that are left are fetched from the table
after that. Ties are broken by the whole texts, so all keys that may still win are fetched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import percent
from plumbline.operators.columns import TEXT, as_text, bounded, is_long, one_row_each, pick, prefix, stack, text_columns, type_of, value

#: Keys whose texts are fetched by broadcast. With more of them all long texts are counted whole.
KEYS = 10_000


def frequency(df: DataFrame, name: str) -> DataFrame:
    """``value, n`` of one column; NULL is a group like any other."""
    return df.select(value(df, name).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def kind_counts(df: DataFrame, name: str) -> DataFrame:
    """As :func:`frequency`, with long texts known by their digest: for counting, not for showing."""
    return df.select(bounded(df, name).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def row_total(df: DataFrame) -> Column:
    """The row count as a scalar subquery: one cheap job, no join."""
    return df.agg(F.count(F.lit(1)).alias("rows")).scalar()


def _shown(df: DataFrame, name: str) -> Column:
    return as_text(type_of(df, name), F.col("value"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value, count, percentage`` for every non-null value; the share is of all rows."""
    total = row_total(df)
    return stack(
        [
            frequency(df, name)
            .where("value is not null")
            .select(
                F.lit(name).alias("column"),
                _shown(df, name).alias("value"),
                F.col("n").alias("count"),
                percent(F.col("n"), total).alias("percentage"),
            )
            for name in pick(df, columns)
        ]
    )


def leading(groups: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k non-null values of a frequency table. Each task keeps k rows; only those are merged.

    NULL is sorted last and dropped after the cut, and the counts stay in use, so that the grouping
    below is word for word the one other figures are read from and the engine runs it once for all.
    """
    first = groups.orderBy(F.col("value").isNull(), *order).limit(k)
    return first.where(F.col("value").isNotNull() & (F.col("n") > 0))


def fetched(rows: DataFrame, keys: DataFrame, at_most: int = KEYS) -> DataFrame:
    """The ``rows`` (``value, key, ...``) that have one of the ``keys`` (column ``key``, each once), to be counted by ``value`` again.

    The keys are broadcast, cut off at ``at_most``. Are there more, all rows are returned instead: the caller filters anyway.
    """
    too_many = keys.agg(F.count(F.lit(1)) > at_most).scalar()
    known = F.broadcast(keys.select("key", F.lit(True).alias("wanted")).limit(at_most))
    return rows.join(known, "key", "left").where(F.col("wanted") | too_many).drop("key", "wanted")


def _long_rows(df: DataFrame, name: str) -> DataFrame:
    """``value, key`` of the texts that are known by a key."""
    return df.select(value(df, name).alias("value"), bounded(df, name).alias("key")).where(is_long(F.col("value")))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def _edge(groups: DataFrame, order: list[Column], k: int) -> Column:
    """The rank of the k-th group, as a scalar subquery."""
    first = leading(groups, order, k).agg(F.array_max(F.collect_list(F.struct(*order))).alias("edge"))
    return first.scalar()


def _not_beyond(rank: Column, edge: Column, kind: Column) -> Column:
    """Whether a group of this kind ranks no later than the edge. The count is in it, so that this stays above the grouping."""
    return F.when((F.col("n") > 0) & F.col("value").isNotNull() & kind, rank) <= edge


def most_frequent(df: DataFrame, name: str, k: int) -> DataFrame:
    """``value, n`` of the k most frequent non-null values, ties by value."""
    order = [F.col("n").desc(), F.col("value").asc()]
    if not isinstance(type_of(df, name), TEXT):
        return leading(frequency(df, name), order, k)
    groups, keys = kind_counts(df, name), [(-F.col("n")).alias("less"), prefix(F.col("value")).alias("prefix")]
    edge, rank, long = _edge(groups, keys, k), F.struct(*keys), is_long(F.col("value"))
    shorts = groups.where(_not_beyond(rank, edge, ~long))
    longs = groups.where(_not_beyond(rank, edge, long)).select(F.col("value").alias("key"))
    return leading(shorts.unionByName(_counted(fetched(_long_rows(df, name), longs))), order, k)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """``column, rank, value, count, percentage`` of the k most frequent values, ties by value."""
    total = row_total(df)
    tops = []
    for name in pick(df, columns):
        few = most_frequent(df, name, k)
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value", _shown(df, name).alias("shown"))))
        tops.append(few.agg(ranked.alias("top")).select(F.lit(name).alias("column"), F.posexplode("top").alias("at", "top")))
    return stack([top.select("column", "at", "top.shown", "top.less") for top in tops]).select(
        "column",
        (F.col("at") + 1).alias("rank"),
        F.col("shown").alias("value"),
        (-F.col("less")).alias("count"),
        percent(-F.col("less"), total).alias("percentage"),
    )


def smallest_values(df: DataFrame, name: str, k: int) -> DataFrame:
    """``value, n`` of the k smallest distinct values.

    For text the beginning of the k-th smallest key is a limit: only texts that begin no later take part, and only the long ones
    of them are read again.
    """
    order = [F.col("value").asc()]
    if not isinstance(type_of(df, name), TEXT):
        return leading(frequency(df, name), order, k)
    groups, begins = kind_counts(df, name), prefix(F.col("value"))
    edge, rank = _edge(groups, [begins.alias("prefix")], k), F.struct(begins.alias("prefix"))
    shorts = groups.where(_not_beyond(rank, edge, ~is_long(F.col("value"))))
    longs = df.select(value(df, name).alias("value")).where(is_long(F.col("value")) & (begins <= edge["prefix"]))
    return leading(shorts.unionByName(_counted(longs)), order, k)


def sample_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """``column, samples``: the k smallest distinct values as text, so that a rerun shows the same."""
    return stack(
        [
            smallest_values(df, name, k).agg(
                F.lit(name).alias("column"),
                F.transform(
                    F.array_sort(F.collect_list(F.struct("value", _shown(df, name).alias("shown")))),
                    lambda s: s["shown"],
                ).alias("samples"),
            )
            for name in pick(df, columns)
        ]
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, rows, nulls, distinct`` (null is no value), exact."""
    n = F.col("n")
    return stack(
        [
            kind_counts(df, name).agg(
                F.lit(name).alias("column"),
                F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("nulls"),
                F.count("value").alias("distinct"),
            )
            for name in pick(df, columns)
        ]
    )


def unique_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both ways of counting unique values.

    ``unique_count`` takes NULL as one value and ``unique_percentage`` is of the non-null rows;
    ``unique`` leaves NULL out and ``unique_pct`` is of all rows.
    """
    with_null = F.col("distinct") + F.when(F.col("nulls") > 0, 1).otherwise(0)
    return distinct_counts(df, columns).select(
        "column",
        with_null.cast("long").alias("unique_count"),
        percent(with_null, F.col("rows") - F.col("nulls")).alias("unique_percentage"),
        F.col("distinct").alias("unique"),
        percent(F.col("distinct"), F.col("rows")).alias("unique_pct"),
    )


def unique_approx(df: DataFrame, columns: Sequence[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """``column, unique_approx`` in one scan and no shuffle of values, for when an estimate will do."""
    rows = [
        F.struct(F.lit(name), F.approx_count_distinct(value(df, name), rsd)) for name in pick(df, columns)
    ]
    return one_row_each(df, rows, "column string, unique_approx bigint")


def category_statistics(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """``column, unique_values, distribution_entropy, most_common`` of text columns.

    The entropy is -sum(p*log2 p) over non-null values with p the share of all rows. Written as
    (sum(n)*log2 N - sum(n*log2 n)) / N it needs the frequencies only, not N beforehand.
    """
    n = F.col("n")
    present = F.when(F.col("value").isNotNull(), n)
    total = F.sum(n)
    entropy = F.try_divide(F.sum(present) * F.log2(total) - F.sum(present * F.log2(n)), total)
    parts = []
    for name in text_columns(df, columns):
        common = most_frequent(df, name, k).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-n).alias("order"), "value"))),
                lambda s: F.struct(s["value"].alias("value"), (-s["order"]).alias("count")),
            ).alias("most_common")
        )
        parts.append(
            kind_counts(df, name).agg(
                F.lit(name).alias("column"),
                F.count("value").alias("unique_values"),
                # no values at all: an empty sum, not an unknown one
                F.coalesce(entropy, F.lit(0.0)).alias("distribution_entropy"),
            ).withColumn("most_common", common.scalar())
        )
    if not parts:
        return df.sparkSession.createDataFrame(
            [],
            "column string, unique_values bigint, distribution_entropy double,"
            " most_common array<struct<value:string,count:bigint>>",
        )
    return stack(parts)

"""Mixing sources to target weights: repetition rates per source, whole copies, and a seeded coin for the rest.

A source's target stops at ``most`` times its size and the excess is shared again among the others by
weight until none is above. That ends in one level: every source gets the smaller of its ceiling and
weight x level. With the sources in order of ceiling per weight, those that reach it come first, so the
level follows from running sums over the sources (a row each), without a loop.

Null texts have size 0; a source of size 0 gets target 0; a null source is a source, in the last place.
Each row draws a coin of its own: it is seeded with the id and a digest of the whole text, of any length, so rows without
an id, or with the same one, differ. Rows that agree in both, found by counting digests, are told apart by their place in
the table, which reruns over the same files keep. An empty table gives an empty table. Columns of the table other than those
named are passed through untouched or not read; if one is called like the number of the copy, that gets another name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import blank_words, small

WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text: Column) -> Column:
    return F.size(blank_words(text)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target, rate`` from a frame of ``source, size``.

    Both windows run over a row per source. Sources are summed with a partial sum in each task first, so a
    source with a third of all rows travels as one row per task.
    """
    whole = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("ceiling", F.lit(most) * F.col("source_size"))
    per = per.withColumn("total", F.lit(share) * F.sum("source_size").over(whole))
    before = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "used": F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # The level if this source and all after it were below their ceilings; right for the first such one.
    per = per.withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("ceiling")
    per = per.withColumn("level", F.min(F.when(fits, F.struct(F.col("ceiling") / F.col("weight"), "level"))).over(whole)["level"])
    target = F.least("ceiling", F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling")))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def coin(key: Column, seed: int) -> Column:
    """Even in [0, 1), from 52 bits of a digest of the seed and the row's key: reruns and retried tasks agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def key_of(id: Column, text: Column) -> Column:
    """The id and the digest of the text."""
    return F.concat_ws(":", F.coalesce(id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))


def with_copies(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``row`` (all columns of the table as a struct), ``size``, its source's figures, and ``copies``.

    copies = floor(rate) + (coin < fraction of the rate), at most ceil(``most``).
    """
    key = key_of(df[id], df[text])
    sized = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), key.alias("key"), df[source].alias("source"), size_of(df[text]).alias("size"))
    sized = sized.withColumn("place", F.monotonically_increasing_id())
    per = targets(df.select(df[source].alias("source"), size_of(df[text]).alias("size")), weights, share, most).withColumnRenamed("source", "of_source")
    joined = sized.join(small(per), F.col("source").eqNullSafe(F.col("of_source")), "left")
    again = df.select(key.alias("again")).groupBy("again").agg(F.count("*").alias("n")).where("n > 1").select("again")
    joined = joined.join(small(again), F.col("key") == F.col("again"), "left")
    own = F.when(F.col("again").isNull(), F.col("key")).otherwise(F.concat_ws(":", "key", "place"))
    whole = F.floor("rate")
    copies = whole + F.when(coin(own, seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"))


def mix(df: DataFrame, copy: str = "copy", **how) -> DataFrame:
    """The mixed table: every row as often as it is taken, numbered from 1 in the column ``copy``.

    If the table has a column of that name, it stays, and the number's name gets underscores until it is free.
    """
    drawn = with_copies(df, **how).where("copies > 0")
    while copy in df.columns:
        copy += "_"
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], F.explode(F.sequence(F.lit(1), "copies")).alias(copy))

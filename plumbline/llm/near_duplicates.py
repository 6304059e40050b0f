"""SimHash near-duplicates by deletion variants.

A text's fingerprint has a bit set if over half of its word shingles' hashes have it. Two fingerprints
that differ in at most three bits differ in at most one bit of one of their two halves. So each half is
indexed under its 32 variants with one bit deleted: halves that differ in one bit share the variant without it. Prints
with an equal half, which share all its variants, are kept from meeting under them and meet under that half and a
segment of the other. Equality joins find every link, and the whole distance is then verified.

Equal fingerprints are one node, so copies never meet in the join, however many there are. Links are
joined to components by alternating star contraction, which keeps one edge for each edge it is given.

Texts are read whole, of any length. Null and blank texts have fingerprint zero and are linked like any other. Repeated rows and ties share
their component. A row with a null id is linked too, but can't name a component; if no row of a component
has an id, its name is null. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.llm.common import shipped
from plumbline.session import stage

SHINGLE = 3
DISTANCE = 3
HALF = 32
#: Shingles whose bits are unfolded at once.
BLOCK = 1 << 16

shipped(__name__)


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    # For bytes, lower() and split() know ASCII only: A-Z, and the blanks 0x20 and 0x09 to 0x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n < 2:
        hashes = np.array([digest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
        stops = (ends - 1)[shingle - 1 :].tolist()
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())  # a type, not its name: a name can be read in a session only
def fingerprint(text: pd.Series) -> pd.Series:
    return text.map(fingerprint_of).astype("int64")


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def halves(print_: str) -> Column:
    """``half, bits, others``: the lower and the upper half of a fingerprint, each with the other one."""
    return F.expr(
        f"inline(transform(array(0, 1), half -> struct(half,"
        f" shiftrightunsigned({print_}, half * {HALF}) & 4294967295L AS bits, shiftrightunsigned({print_}, (1 - half) * {HALF}) & 4294967295L AS others)))"
    )


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: all pairs of different fingerprints (a < b) within the distance, each once.

    Halves that differ in one bit are alike without it: a print with the bit set meets those without it, so prints with an
    equal half don't meet under its variants. They meet once, under the half and one of the other half's segments: that has as many
    as bits that may differ and one more, so one is equal. A pair is reported by the first half and segment that finds it.
    """
    cut = prints.select("print", halves("print"))
    width = HALF // (DISTANCE + 1)
    segments = F.expr(f"inline(transform(sequence(0, {DISTANCE}), s -> struct(s AS segment, shiftright(others, s * {width}) & {(1 << width) - 1}L AS part)))")
    equal = cut.select("print", "half", "bits", segments)
    left, right = equal.withColumnRenamed("print", "a"), equal.withColumnRenamed("print", "b")
    # shuffled by hint: sizes are guessed from before the keys multiply the rows, so a side would be broadcast that must not be
    same = left.hint("shuffle_merge").join(right, ["half", "bits", "segment", "part"]).select("a", "b", "half", "segment", F.col("a").bitwiseXOR(F.col("b")).alias("d"))
    # the other half of the difference has no equal segment before this one
    rest = F.expr("shiftrightunsigned(d, (1 - half) * 32) & 4294967295L")
    earlier = F.lit(True)
    for s in range(1, DISTANCE + 1):
        earlier &= (F.col("segment") < s) | (F.shiftright(rest, (s - 1) * width).bitwiseAND(F.lit((1 << width) - 1)) != 0)
    same = same.where((F.col("a") < F.col("b")) & earlier)

    bit = F.expr(f"inline(transform(sequence(0, {HALF - 1}), bit -> struct(bit, shiftright(bits, bit) & 1 AS is_set, bits & ~shiftleft(1L, bit) AS without)))")
    one = cut.select("print", "half", bit)
    unset, is_set = (one.where(F.col("is_set") == k).select(F.col("print").alias(n), "half", "bit", "without") for k, n in ((0, "x"), (1, "y")))
    differ = unset.hint("shuffle_merge").join(is_set, ["half", "bit", "without"])
    differ = differ.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "half", F.col("x").bitwiseXOR(F.col("y")).alias("d"))
    # what the lower half finds, equal or with one bit, the upper one doesn't report
    by_lower = F.expr("bit_count(d & 4294967295L) <= 1")
    return same.select("a", "b", "half", "d").union(differ).where((F.bit_count("d") <= DISTANCE) & ((F.col("half") == 0) | ~by_lower)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of an edge (``a, b``) reaches.

    Large and small stars in turn until nothing changes: every round points all neighbours of a node at
    the least of them, which about halves the height of what is left. Rounds are written to the shared folder.
    """
    edges = stage(edges.select("a", "b"), "links")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours of a node go to the least node of its star
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # smaller neighbours and the node itself go to the least of the smaller ones
        small_ = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stage(small_.distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, print, component_id``: a row for each row of the table."""
    prints = stage(df.select(df[id].alias("id"), fingerprint(df[text]).alias("print")), "prints")
    nodes = prints.groupBy("print").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("print")))
    named = nodes.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("print", "root").join(names, "root").select("print", "component_id")
    return prints.join(named, "print").select("id", "print", "component_id")

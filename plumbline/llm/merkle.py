"""A Merkle manifest of a table: sibling-shift self-joins.

Every row is a leaf. The leaves of a group are numbered in their order, and every ``arity`` consecutive nodes
become their parent. At each level the nodes are equijoined with themselves, once for each slot offset, on the
computed number of a sibling (for two it is the number with its last bit flipped, an XOR): that gives a node
the digests beside it, and the rows in slot zero, which then hold a whole run of siblings, emit the parents. The
roots of the groups are the leaves of one more tree, in the order of the groups.

The way from a leaf to the root is put together from the top down: a node's way is its own siblings and then
its parent's way, so each level joins once with the level above it, and a leaf gets its whole proof without
meeting any other leaf. Folding a leaf with its proof is one expression.

Numbering does not sort a group in one task, however large the group: rows are range-partitioned by group and
order, numbered within their partition, and moved on by the rows of their group in the partitions before. A hot
group is spread over as many ranges as its size asks for, and so are equal rows. Joins are on (group, number), which
no two rows share, so they spread evenly. Each level is written to the shared folder, so a lost executor costs one level at most;
levels shrink by the arity, and all of them together hold 1.5 times the leaves for runs of three. Building the
frame runs a few jobs for each level.

Digests are SHA-256, 32 bytes in transit and lowercase hex when hashed again. Null columns, empty texts and
texts of any length are leaves like others. Rows of one group with equal order keys are ordered by leaf, so equal
rows have the same leaf, and their places among themselves do not show. Null order keys come first. An empty
table has no root and gives an empty table. A group may be null; it is a group of its own and comes first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small
from plumbline.session import stage

ARITY = 3


def digest(hashed: Column) -> Column:
    """The SHA-256 of a text or of bytes, as 32 bytes."""
    return F.unhex(F.sha2(hashed.cast("binary"), 256))


def as_hex(digest_: Column) -> Column:
    return F.lower(F.hex(digest_))


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' number, a colon and the value, so that no two rows are written alike."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The leaf of a row of these values."""
    return digest(F.concat(*[framed(v) for v in values]))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (staged, with a column ``grp``) with ``at``, their number in the group by ``order``, and ``of``, the group's rows."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("grp", *order, "tie").sortWithinPartitions("grp", *order, "tie").drop("tie")
    ranged = stage(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "leaves")
    # A row for each range and group: a group in several ranges fills all but its first and last
    parts = ranged.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    parts = stage(parts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("of")), "ranges")
    placed = ranged.join(small(parts), ["grp", "part"])
    return placed.withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes`` (``grp, at, digest, ...``) with ``beside_k``, the digest ``k`` slots on in their run, null past its end."""
    slot = F.col("at") % arity
    joined = nodes
    for offset in range(1, arity):
        other = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + (slot + offset) % arity
        shifted = nodes.select("grp", F.col("at").alias("beside_at"), F.col("digest").alias(f"beside_{offset}"))
        joined = joined.withColumn("beside_at", other).join(shifted, ["grp", "beside_at"], "left").drop("beside_at")
    return joined


def _together(offsets: range, arity: int) -> Column:
    """The digests at these offsets from a node, one after the other; none for slots past the end."""
    return F.concat(F.lit(b""), *[F.coalesce(F.col(f"beside_{k % arity}"), F.lit(b"")) for k in offsets])


def levels(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """Every level of the trees over ``leaves`` (``grp, at, of, digest, ...``), each staged with ``left`` and ``right``.

    These are the digests beside a node. A group whose level is a single node ends there. The first level keeps all
    columns of the leaves.
    """
    made, nodes = [], leaves
    most = leaves.agg(F.max("of")).first()[0] or 0
    while True:
        joined = with_siblings(nodes, arity)
        left = right = F.lit(b"")
        for s in range(arity):
            here = F.col("at") % arity == s
            left = F.when(here, _together(range(arity - s, arity), arity)).otherwise(left)
            right = F.when(here, _together(range(1, arity - s), arity)).otherwise(right)
        made.append(stage(joined.select(*nodes.columns, left.alias("left"), right.alias("right")), "level"))
        if most <= 1:
            return made
        most = -(-most // arity)
        # The rows in slot zero have their whole run beside them
        nodes = made[-1].where((F.col("of") > 1) & (F.col("at") % arity == 0)).select(
            "grp",
            F.floor(F.col("at") / arity).alias("at"),
            F.ceil(F.col("of") / arity).alias("of"),
            digest(as_hex(F.concat("digest", "right"))).alias("digest"),
        )


def tops_of(made: list[DataFrame]) -> DataFrame:
    """``grp, digest``: the last node of every group."""
    tops = made[0].where("of = 1").select("grp", "digest")
    for nodes in made[1:]:
        tops = tops.union(nodes.where("of = 1").select("grp", "digest"))
    return tops


def ways(made: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``way``: the siblings from the leaf up, then the way of its group's top.

    ``tops`` has a row for each group: ``grp, way`` and further columns, which come down with the way. A step of a
    way is ``left, right``; a node without siblings has an empty step, which hashes it alone.
    """
    step = F.array(F.struct("left", "right"))
    passed = [c for c in tops.columns if c != "grp"]
    above = None
    for nodes in reversed(made):
        kept = [c for c in nodes.columns if c not in ("of", "left", "right") and (nodes is made[0] or c != "digest")]
        found = nodes.where("of = 1").select(*kept).join(tops, "grp")
        if above is not None:
            lower = nodes.where("of > 1").withColumn("up", F.floor(F.col("at") / arity)).join(above.withColumnRenamed("at", "up"), ["grp", "up"])
            found = found.unionByName(lower.withColumn("way", F.concat(step, "way")).select(*kept, *passed))
        above = found if nodes is made[0] else stage(found, "ways")
    return above


def folded(start: Column, way: Column) -> Column:
    """The root that a leaf and its way lead to."""
    return F.aggregate(way, start, lambda node, step: digest(as_hex(F.concat(step["left"], node, step["right"]))))


def proof(way: Column) -> Column:
    """The siblings of a way, level by level from the leaf to the root, left to right, joined as hex."""
    return F.array_join(F.transform(way, lambda step: as_hex(F.concat(step["left"], step["right"]))), "")


def manifest(df: DataFrame, group: str, order: str, leaf_of: Column, carry: Mapping[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """``id, grp, digest, subroot, root, way`` and the carried columns, for every row.

    ``digest`` is the row's leaf, ``subroot`` the top of its group's tree, ``root`` that of all groups' tops, ``way`` the
    siblings between, as ``array<struct<left, right>>`` (see :func:`folded` and :func:`proof`). ``grp.value`` is the group.
    """
    # as one column, so that their names can't clash with others
    carried = F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in (carry or {}).items()]).alias("carried")
    rows = df.select(F.struct(df[group].alias("value")).alias("grp"), df[order].alias("id"), leaf_of.alias("digest"), carried)
    made = levels(numbered(stage(rows, "rows"), ["id", "digest"]), arity)
    # The tops of the groups are the leaves of one more tree
    tops = stage(tops_of(made).select(F.struct(F.lit(0).alias("value")).alias("grp"), F.col("grp").alias("below"), "digest"), "tops")
    over = levels(numbered(tops, ["below"]), arity)
    root = over[-1].select("grp", F.array().cast("array<struct<left: binary, right: binary>>").alias("way"), F.col("digest").alias("root"))
    upper = ways(over, root, arity).select(F.col("below").alias("grp"), "way", F.col("digest").alias("subroot"), "root")
    return ways(made, stage(upper, "tops"), arity).select("id", "grp", "digest", *[F.col("carried")[n].alias(n) for n in carry or {}], "subroot", "root", "way")

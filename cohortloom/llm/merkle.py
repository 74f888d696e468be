"""Merkle manifest of a table (operator 12): leaves by group, subroots, a root, and an inclusion proof of every row.

The leaves of a group stand in the order of an id. Their places come from one range-partitioned sort and the counts of
its partitions, so that a group of any size needs no single task. A level is built by sibling shifts: node ``i`` is slot
``i % fanout`` of run ``i // fanout``; the slot-zero rows meet the rows of each other slot by an equijoin on the
computed run, side by side, and emit the parents. Groups that are down to one node wait; their subroots then form the
tree above in the same way. On the way back, every node hands its path to the runs below it.

A level is written in the shared folder before the next one reads it. All digests are lower-case hex text; a parent is
the SHA-256 of its children's digests, one after another, also where a run has one child only.

Defined results: null values are written ``-``, others by their length in bytes, ``:`` and the value. A null group is a
group of its own and comes first; null ids come first in their group. Rows with equal ids stand in the order of their
leaves, equal rows in any order (their digests are equal). Texts are hashed whole. An empty table has no root and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def canonical(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and its text; null as a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[canonical(v) for v in values]), 256)


def depth_of(n: Column, fanout: int) -> Column:
    """Levels between ``n`` leaves and their last node: the smallest power of ``fanout`` that holds them."""
    powers = [fanout**k for k in range(64) if fanout**k < 2**62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


def numbered(df: DataFrame, order: Sequence[Column], group: str) -> DataFrame:
    """``df`` with ``i``, its place within its group in the order of group and ``order``, from 0, and ``n_group``.

    A range-partitioned sort gives places within partitions. Only counts per partition and group are put in a window:
    per group as many rows as it has partitions.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    parts = rows.groupBy(part.alias("in_part"), F.col(group).alias("in_group")).agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("in_group")
    before = whole.orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n_group", F.sum("c").over(whole))
    rows = rows.join(parts, (part == F.col("in_part")) & F.col(group).eqNullSafe(F.col("in_group")))
    return rows.select(*df.columns, (F.col("m") - F.col("low") + F.col("before")).alias("i"), "n_group")


def runs_of(nodes: DataFrame, fanout: int) -> DataFrame:
    """Per run of ``nodes`` (g, depth, i, h, own): its digests ``hs`` in order, their ``own`` and the ``parent``."""
    nodes = nodes.select("g", "depth", F.floor(F.col("i") / fanout).alias("run"), (F.col("i") % fanout).alias("slot"), F.struct("h", "own").alias("n0"))
    out = nodes.where("slot = 0").drop("slot")
    for k in range(1, fanout):
        sibling = nodes.where(F.col("slot") == k).select(F.col("g").alias("g_k"), F.col("run").alias("run_k"), F.col("n0").alias(f"n{k}"))
        out = out.join(sibling, F.col("g").eqNullSafe(F.col("g_k")) & (F.col("run") == F.col("run_k")), "left").drop("g_k", "run_k")
    there = F.filter(F.array(*[F.col(f"n{k}") for k in range(fanout)]), lambda x: x.isNotNull())
    out = out.select("g", "depth", "run", there.alias("n")).withColumn("hs", F.transform("n", lambda x: x["h"]))
    return out.select("g", "depth", "run", "hs", F.transform("n", lambda x: x["own"]).alias("own"), F.sha2(F.array_join("hs", ""), 256).alias("parent"))


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, and (g, depth, h): the last node of every group."""
    tops = nodes.where("depth = 0").select("g", "depth", "h")
    levels: list[DataFrame] = []
    for level in range(nodes.agg(F.max("depth")).first()[0] or 0):
        levels.append(cut(runs_of(nodes.where(F.col("depth") > level), fanout)))
        nodes = levels[-1].select("g", "depth", F.col("run").alias("i"), F.col("parent").alias("h"), F.lit(None).cast("int").alias("own"))
        tops = tops.union(nodes.where(F.col("depth") == level + 1).select("g", "depth", "h"))
    return levels, cut(tops)


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """(g, i, h, own, path) of the lowest nodes of ``levels``, from the paths of the groups' last nodes (g, depth, path).

    A path lists, from below, the digests to the left and to the right of the node's own within its run.
    """
    nodes = None
    for level in range(len(levels) - 1, -1, -1):
        above = tops.where(F.col("depth") == level + 1).select(F.col("g").alias("a_g"), F.lit(0).cast("long").alias("a_i"), "path")
        if nodes is not None:
            above = above.union(nodes.select("g", "i", "path"))
        runs = levels[level].join(above, F.col("g").eqNullSafe(F.col("a_g")) & (F.col("run") == F.col("a_i")))
        runs = runs.select("g", "run", "hs", "own", "path", F.posexplode("hs").alias("slot", "h"))
        step = F.struct(F.array_join(F.slice("hs", F.lit(1), F.col("slot")), "").alias("left"),
                        F.array_join(F.slice("hs", F.col("slot") + 2, F.lit(fanout)), "").alias("right"))
        nodes = runs.select("g", (F.col("run") * fanout + F.col("slot")).alias("i"), "h", F.get("own", F.col("slot")).alias("own"),
                            F.concat(F.array(step), F.col("path")).alias("path"))
    return nodes


def proof(path: Column) -> Column:
    """SHA-256 of all digests of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf_digest, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest(df: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = 8,
             keep: Sequence[str] = ("doc_id",), **carried: Column) -> DataFrame:
    """Per row of ``df``: ``row`` (the columns of ``keep``), ``carried`` columns, ``leaf``, ``subroot``, ``root``, ``path``.

    Only digests, the kept columns and the carried ones leave the scan.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("int").alias("_"))
    extra = F.struct(*[c.alias(n) for n, c in carried.items()], F.lit(None).cast("int").alias("_"))
    leaves = cut(df.select(F.struct(kept.alias("row"), extra.alias("carried")).alias("own"), F.col(f"`{group}`").alias("g"),
                           F.col(f"`{order}`").alias("o"), leaf([F.col(f"`{c}`") for c in fields]).alias("h")))
    nodes = cut(numbered(leaves, [F.col("o").asc_nulls_first(), F.col("h")], "g").select(
        "g", depth_of(F.col("n_group"), fanout).alias("depth"), "i", "h", "own"))
    levels, subroots = climb(nodes, fanout)
    # The tree above: the groups' last nodes in the order of the groups, as one group.
    upper = numbered(subroots.select(F.lit(0).alias("one"), F.col("g").alias("of"), F.col("depth").alias("below"), "h"), [F.col("of").asc_nulls_first()], "one")
    upper = cut(upper.select(F.lit(0).alias("g"), depth_of(F.col("n_group"), fanout).alias("depth"), "i", "h", F.struct("of", "below").alias("own")))
    upper_levels, top = climb(upper, fanout)
    root = top.select("h").first()
    nowhere = F.array().cast("array<struct<left:string,right:string>>")
    start = top.select("g", "depth", nowhere.alias("path"))
    if upper_levels:
        paths = descend(upper_levels, start, fanout)
    else:
        paths = upper.withColumn("path", nowhere)
    paths = cut(paths.select(F.col("own.of").alias("g"), F.col("own.below").alias("depth"), F.col("h").alias("subroot"), "path"))
    # A leaf alone in its group is its subroot; all others come down the levels.
    same = F.col("g").eqNullSafe(F.col("s_g"))
    named = paths.select(F.col("g").alias("s_g"), "subroot")
    alone = nodes.where("depth = 0").join(paths.select(F.col("g").alias("s_g"), "subroot", "path"), same).select("own", "h", "subroot", "path")
    if levels:
        alone = alone.union(descend(levels, paths.select("g", "depth", "path"), fanout).join(named, same).select("own", "h", "subroot", "path"))
    return alone.select("own.row", *[F.col("own.carried")[n].alias(n) for n in carried], F.col("h").alias("leaf"), "subroot",
                        F.lit(root["h"] if root else None).cast("string").alias("root"), "path")

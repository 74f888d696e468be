"""Mixing sources to target weights (operator 1), in DataFrame functions only.

A tree domain > language > source carries a weight at every node. The token budget runs down the tree. A child that has
less than its share (its tokens times the allowed epochs) gives the rest to its siblings, by their weights; only what
all siblings together cannot use is missing one level higher, where the parent's siblings take it. Each leaf then gets
whole epochs and, in the last one, the documents at the front of a seeded order until its tokens are reached.

Defined results: a null text has no tokens and is never taken beyond whole epochs of its leaf. Null domain, language
or source are values of their own. A node without a given weight weighs 1; weights below or equal to 0 take nothing.
Equal rows share a place in the order and are taken together. A budget above all tokens times epochs takes everything.
An empty table gives an empty result. All working columns live beside a struct, so clashing names do not matter.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import WHITE, cut, text_or_empty

LEVELS = ["domain", "lang", "source"]


def tokens_of(text: str) -> Column:
    """Words between white space; an empty text has none."""
    return F.size(F.filter(F.split(text_or_empty(text), WHITE), lambda x: x != "")).cast("long")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch's order: a hash of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-"))))


def poured(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """``nodes`` with ``share``: how much of the parent's ``budget`` each child gets of ``weight`` and ``room``.

    Children whose room per weight is smallest fill first. With those before a child full, the rest of the budget is
    spread over the remaining weights; a child is full where that level exceeds its own room per weight.
    """
    ratio = F.when(F.col("weight") > 0, F.col("room") / F.col("weight"))
    nodes = nodes.withColumn("ratio", ratio).withColumn("usable", F.when(F.col("weight") > 0, F.col("room")).otherwise(F.lit(0.0)))
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = by.orderBy(F.col("ratio").asc_nulls_last(), *LEVELS).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(budget) - F.coalesce(F.sum("usable").over(before), F.lit(0.0))
    weights = F.sum(F.greatest("weight", F.lit(0.0))).over(by) - F.coalesce(F.sum(F.greatest("weight", F.lit(0.0))).over(before), F.lit(0.0))
    level = F.when(weights > 1e-12, left / weights)
    nodes = nodes.withColumn("level", level)
    # From the first child that is not full on, all have that child's level.
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("col2")))).over(by)
    nodes = nodes.withColumn("settled", -settled["col2"])
    return nodes.withColumn("share", F.when(F.col("weight") <= 0, F.lit(0.0)).otherwise(
        F.least(F.col("usable"), F.coalesce(F.col("settled") * F.col("weight"), F.col("usable"))))).drop(
        "ratio", "usable", "level", "settled")


def budgets(leaves: DataFrame, weights: DataFrame | None, budget: float, max_epochs: float) -> DataFrame:
    """Per leaf ``tokens`` and ``share`` (target tokens, whole numbers) for ``budget`` times all tokens.

    ``weights`` has columns domain, lang, source and weight. A row names the node of its last value that is not null, so
    a null lang and source name a domain; a node whose own name is null weighs 1. Only leaves that may be used, with
    weights above 0 all the way up, count as room, so no budget goes where none can be spent.
    The table of leaves has one row per source and language, far fewer than documents.
    """
    n = leaves.agg(F.sum("tokens").alias("all_tokens"))
    nodes = leaves.join(F.broadcast(n)).withColumn("budget", F.col("all_tokens") * F.lit(float(budget)))
    for depth in range(1, len(LEVELS) + 1):
        if weights is None:
            nodes = nodes.withColumn(f"w{depth}", F.lit(1.0))
            continue
        given = weights.where(F.col(LEVELS[depth - 1]).isNotNull())
        for name in LEVELS[depth:]:
            given = given.where(F.col(name).isNull())
        keys = LEVELS[:depth]
        given = given.select(*[F.col(k).alias(f"g_{k}") for k in keys], F.col("weight").cast("double").alias("given"))
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys])
        nodes = nodes.join(given, on, "left").withColumn(f"w{depth}", F.coalesce("given", F.lit(1.0))).drop("given", *[f"g_{k}" for k in keys])
    used = reduce(and_, [F.col(f"w{d}") > 0 for d in range(1, len(LEVELS) + 1)])
    nodes = nodes.withColumn("leaf_room", F.when(used, F.col("tokens") * F.lit(float(max_epochs))).otherwise(F.lit(0.0)))
    for depth in range(1, len(LEVELS) + 1):
        keys, parent = LEVELS[:depth], LEVELS[:depth - 1]
        level = nodes.groupBy(*keys).agg(F.sum("leaf_room").alias("room"), F.first("budget").alias("budget"), F.first(f"w{depth}").alias("weight"))
        for name in LEVELS[depth:]:
            level = level.withColumn(name, F.lit(None).cast("string"))
        level = poured(level, parent, "budget").select(*[F.col(k).alias(f"l_{k}") for k in keys], "share")
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys])
        nodes = nodes.join(level, on).drop("budget", *[f"l_{k}" for k in keys]).withColumnRenamed("share", "budget")
    return nodes.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("share"))


def mixed(df: DataFrame, tree: list[Column], weights: DataFrame | None = None, budget: float = 1.0,
          max_epochs: int = 4, seed: int = 1, doc_id: str = "doc_id", text: str = "text", rank_rows: int = 4096) -> DataFrame:
    """``df``'s rows as struct ``row`` with ``epochs`` (how many times taken), ``n_tokens`` and the leaf's columns.

    ``tree`` gives the columns of domain, language and source. Only ids and token counts are shuffled: an order hash
    that cuts the leaf at its remainder is found per leaf, in two steps (totals of ``rank_rows``-sized slices of the
    order, then the one slice that holds the cut), and rows are compared with it where they lie.
    """
    keys = [c.cast("string").alias(n) for c, n in zip(tree, LEVELS)]
    light = cut(df.select(*keys, F.col(f"`{doc_id}`").alias("id"), tokens_of(f"`{text}`").alias("n_tokens")))
    leaves = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    shares = budgets(leaves.select(*LEVELS, "tokens"), weights, budget, max_epochs)
    shares = shares.select(*[F.col(k).alias(f"s_{k}") for k in LEVELS], "tokens", "share")
    same = lambda p: [F.col(k).eqNullSafe(F.col(f"{p}_{k}")) for k in LEVELS]
    plan = leaves.select(*LEVELS, "n").join(shares, same("s")).select(
        *LEVELS, "n", F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(F.lit(0)).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("share") % F.col("tokens")).otherwise(F.lit(0)).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / rank_rows)).cast("long").alias("slices"))
    plan = cut(plan)  # one row per leaf
    leaf = plan.select(*[F.col(k).alias(f"p_{k}") for k in LEVELS], "whole", "rest", "slices")
    placed = light.join(leaf, same("p")).where(F.col("rest") > 0).withColumn("at", place(seed, F.col("whole"), F.col("id")))
    number = F.conv(F.substring("at", 1, 8), 16, 10).cast("long")
    placed = placed.select(*LEVELS, "at", "n_tokens", "rest", F.floor(number * F.col("slices") / F.lit(2 ** 32)).alias("slice"))
    totals = placed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.sum("t").over(run)).withColumn("start", F.col("upto") - F.col("t"))
    edge = totals.where((F.col("start") < F.col("rest")) & (F.col("upto") >= F.col("rest"))).select(
        *[F.col(k).alias(f"e_{k}") for k in LEVELS], F.col("slice").alias("e_slice"), "start")
    inside = placed.join(edge, [*same("e"), F.col("slice") == F.col("e_slice")])
    inside = inside.groupBy(*LEVELS, "at").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    run = Window.partitionBy(*LEVELS).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("begin", F.col("start") + F.sum("t").over(run) - F.col("t"))
    last = inside.where(F.col("begin") < F.col("rest")).groupBy(*LEVELS).agg(F.max("at").alias("last"))
    last = last.select(*[F.col(k).alias(f"c_{k}") for k in LEVELS], "last")
    # Written, so that its size is known and Spark broadcasts it only below the session's threshold.
    final = cut(plan.join(last, same("c"), "left").select(*[F.col(k).alias(f"f_{k}") for k in LEVELS], "whole", "last"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *keys, F.col(f"`{doc_id}`").alias("id"), text_or_empty(f"`{text}`").alias("t"))
    rows = rows.join(final, same("f")).withColumn("epochs", F.col("whole") + F.coalesce(
        (place(seed, F.col("whole"), F.col("id")) <= F.col("last")).cast("int"), F.lit(0)))
    return rows.where(F.col("epochs") > 0).select("row", *LEVELS, "epochs", "id", "t")

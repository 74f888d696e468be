"""Count-and-percent tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.functions.labels import Levels, as_level, level_count, level_rank
from cohortloom.functions.numeric import count_with_percent, fixed2, percent, round2
from cohortloom.functions.predicates import not_listed
from cohortloom.operators.counts import count_by, total_of, with_percent


def group_distribution(df: DataFrame, key: str, levels: Levels | None = None) -> DataFrame:
    """People per group with the share of the whole cohort, rounded to two decimals.

    The missing group is a row of its own and part of the total. In level order, unlisted
    groups last, when levels are given; otherwise largest first.
    """
    return distribution_of(count_by(df, key, name="n_people"), key, levels)


def distribution_of(counts: DataFrame, key: str, levels: Levels | None = None) -> DataFrame:
    """The same from people already counted in a column ``n_people``."""
    table = counts.withColumn("percent", round2(percent(F.col("n_people"), total_of(counts, "n_people"))))
    if levels is None:
        return table.orderBy(F.desc("n_people"), F.asc(key))
    return table.orderBy(level_rank(F.col(key), levels).asc_nulls_last(), F.asc(key))


def ordered_table(df: DataFrame, answer: str = "answer", levels: Levels | None = None,
                  refusals: Sequence[str] = tuple(vocab.REFUSALS), by: Sequence[str] = ()) -> DataFrame:
    """Count, two-decimal percent text and a Total row, refusals left out.

    ``by`` makes one table per group in the same job.
    """
    counts = count_by(df.filter(not_listed(F.col(answer), refusals)), *by, answer, name="count")
    return ordered_from_counts(counts, answer, levels, by)


def ordered_from_counts(counts: DataFrame, answer: str = "answer", levels: Levels | None = None,
                        by: Sequence[str] = ()) -> DataFrame:
    """The same from answers already counted in a column ``count``.

    Counted before labels are mapped to levels, so each unlisted answer keeps a row and shows
    as NULL. ``row_order`` is the level number, then unlisted answers, then Total; without
    levels the rows stay in label order.
    """
    shares = with_percent(counts, "count", by)
    sums = [F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.coalesce(F.sum("percent"), F.lit(0.0)).alias("percent")]
    is_total = F.col("__total")
    if by:  # each share goes to its own row and to its group's total, in one aggregation
        twice = shares.withColumn("__total", F.explode(F.array(F.lit(False), F.lit(True))))
        table = twice.groupBy(*by, "__total", F.when(~is_total, F.col(answer)).alias(answer)).agg(*sums)
    else:  # an ungrouped aggregate has its row, a total of 0, even without any answers
        table = (shares.withColumn("__total", F.lit(False))
                 .unionByName(shares.agg(*sums).withColumns({answer: F.lit(None).cast("string"), "__total": F.lit(True)})))
    rank, label, last = F.lit(1), F.col(answer), F.lit(2)
    if levels is not None:
        rank = F.coalesce(level_rank(F.col(answer), levels), level_count(levels) + 1)
        label, last = as_level(F.col(answer), levels), level_count(levels) + 2
    return (table.select(*by, F.when(is_total, last).otherwise(rank).alias("row_order"),
                         F.when(is_total, "Total").otherwise(label).alias(answer),
                         "count", fixed2(F.col("percent")).alias("percent"))
                 .orderBy(*by, "row_order", answer))


def stratified_np(df: DataFrame, group: str, answer: str, levels: Levels | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """``n (p%)`` per group and answer, the percent taken inside the group.

    All strata in one aggregation. Labels are mapped to levels first, so unlisted answers of a
    group share one NULL row.
    """
    if levels is not None:
        df = df.withColumn(answer, as_level(F.col(answer), levels))
    return np_from_counts(count_by(df, *by, group, answer, name="count"), group, answer, levels, by)


def np_from_counts(counts: DataFrame, group: str, answer: str, levels: Levels | None = None,
                   by: Sequence[str] = ()) -> DataFrame:
    """The same from levels already counted in a column ``count``."""
    shares = with_percent(counts, "count", [*by, group])
    rank = level_rank(F.col(answer), levels) if levels is not None else F.lit(None).cast("int")
    return (shares.withColumn("value", count_with_percent(F.col("count"), F.col("percent")))
                  .withColumn("row_order", rank)
                  .select(*by, group, "row_order", answer, "count", "percent", "value"))


def stratified_np_wide(table: DataFrame, group: str, answer: str, groups: Sequence[str],
                       by: Sequence[str] = ()) -> DataFrame:
    """One column of ``n (p%)`` cells per listed group; a cell without rows is NULL."""
    cells = [F.max(F.when(F.col(group) == g, F.col("value"))).alias(g) for g in groups]
    return (table.filter(F.col(group).isin(list(groups)))
                 .groupBy(*by, "row_order", answer).agg(*cells)
                 .orderBy(*by, F.col("row_order").asc_nulls_last()))

"""Counts, shares and small summary frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.numeric import percent


def count_by(df: DataFrame, *keys: str, name: str = "n", weight: str | None = None) -> DataFrame:
    """Rows per key combination, or the sum of a weight; NULL is a key of its own."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias(name))


def count_joined(rows: DataFrame, people: DataFrame, row_keys: Sequence[str], people_keys: Sequence[str],
                 key: str = "person_id", name: str = "count") -> DataFrame:
    """Rows of ``rows`` joined to ``people``, counted per (people_keys, row_keys).

    ``rows`` is first counted per key: with map-side combining a key that holds a third of the
    rows reaches the join as one row per distinct answer, on one side of the join or both.
    """
    per_key = count_by(rows, key, *row_keys, name="__n")
    joined = per_key.join(people.select(key, *people_keys), key)
    return count_by(joined, *people_keys, *row_keys, name=name, weight="__n")


def frequency(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key combination, rows with a missing key left out."""
    return count_by(df.dropna(subset=list(keys)), *keys, name=name)


def distinct_count(column: str) -> Column:
    """Exact distinct count in which NULL counts as one value.

    Spark shuffles on (group, value), so one hot group is still counted by many tasks.
    """
    has_null = F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
    return F.count_distinct(column) + has_null


def distinct_by(df: DataFrame, key: str, of: str = "person_id", name: str = "n_people") -> DataFrame:
    """Distinct values per group."""
    return df.groupBy(key).agg(distinct_count(of).alias(name))


def duplicates(df: DataFrame, key: str = "person_id", name: str = "n") -> DataFrame:
    """Keys that occur more than once."""
    return count_by(df, key, name=name).filter(F.col(name) > 1)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column, NULL included."""
    return df.select(column).distinct()


def total_of(counts: DataFrame, count: str = "n", by: Sequence[str] = ()) -> Column:
    """Sum of an already aggregated count, over everything or inside each ``by`` group.

    Over everything it is a scalar subquery that reuses the shuffle of ``counts``, so no task
    sees all groups. Inside ``by`` it is a window whose partitions hold the labels of a group.
    """
    if by:
        return F.sum(count).over(Window.partitionBy(*by))
    return counts.agg(F.sum(count)).scalar()


def with_percent(counts: DataFrame, count: str = "n", by: Sequence[str] = (), name: str = "percent") -> DataFrame:
    """Add each row's share of the total, 0 to 100."""
    return counts.withColumn(name, percent(F.col(count), total_of(counts, count, by)))


def percent_table(df: DataFrame, key: str) -> DataFrame:
    """Count and percent per key, largest first."""
    return with_percent(count_by(df, key, name="count"), "count").orderBy(F.desc("count"), F.asc(key))


def largest_group(df: DataFrame, key: str) -> DataFrame:
    """The most frequent key, the first in label order on a tie."""
    return count_by(df, key).orderBy(F.desc("n"), F.asc(key)).limit(1)


def stack_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack rows by column name; a column a frame lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def head_rows(df: DataFrame, n: int = 6, order: Sequence[str] = ()) -> DataFrame:
    """The first rows; with an order the same ones every time."""
    return (df.orderBy(*order) if order else df).limit(n)

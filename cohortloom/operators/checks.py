"""Reconciliation of totals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_total(df: DataFrame) -> DataFrame:
    """One row: how many rows there are."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def sum_total(df: DataFrame, column: str) -> DataFrame:
    """One row: the sum of a count column."""
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def reconcile(checks: Sequence[tuple[str, Sequence[DataFrame], Sequence[DataFrame]]]) -> DataFrame:
    """One row per check: the sum of the left totals, of the right totals, and whether they agree.

    Each total is a one-row frame, so only single numbers are brought together.
    """
    sides = [part.select(F.lit(name).alias("check"), F.lit(side).alias("side"), F.col("total"))
             for name, left, right in checks
             for side, parts in (("left", left), ("right", right)) for part in parts]
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("total")))
    return (reduce(DataFrame.union, sides).groupBy("check")
            .agg(side("left").alias("left_total"), side("right").alias("right_total"))
            .withColumn("agrees", F.col("left_total") == F.col("right_total")))


def reconcile_counted(counted: DataFrame, checks: Sequence[tuple[str, Sequence[Column], Sequence[Column]]],
                      count: str = "n") -> DataFrame:
    """The same table from one frame of counts: each total is the sum of the rows that a condition picks.

    All totals come from one aggregation, so the data behind the counts is read once, however many
    checks there are.
    """
    total = lambda picks: reduce(Column.__add__, [F.coalesce(F.sum(F.when(p, F.col(count))), F.lit(0)) for p in picks])
    row = counted.agg(*[F.struct(F.lit(name).alias("check"), total(left).alias("left_total"),
                                 total(right).alias("right_total")).alias(f"c{i}")
                        for i, (name, left, right) in enumerate(checks)])
    return (row.select(F.inline(F.array(*row.columns)))
               .withColumn("agrees", F.col("left_total") == F.col("right_total")))

"""Cohort algebra on id columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.operators.sizing import broadcast_if_small


def flagged(df: DataFrame, flags: Sequence[str] = tuple(vocab.DATA_FLAGS), key: str = "person_id") -> DataFrame:
    """Ids of rows with at least one flag set: one scan, instead of a union of one per flag."""
    return df.filter(reduce(Column.__or__, [F.col(f) == 1 for f in flags])).select(key)


def any_flag(df: DataFrame, flags: Sequence[str] = tuple(vocab.DATA_FLAGS), key: str = "person_id") -> DataFrame:
    """The same ids, each once.

    As the right side of a sort-merge join this costs no further shuffle, and an id that repeats
    very often is folded before the one there is.
    """
    return flagged(df, flags, key).distinct()


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Set union of frames with the same columns."""
    return reduce(DataFrame.union, frames).distinct()


def carriers(variants: DataFrame, vids: Sequence[str]) -> DataFrame:
    """One row per (variant, carrier). The variant filter runs below the explode, in the scan."""
    return (variants.filter(F.col("vid").isin(list(vids)))
                    .select(F.explode("person_ids").alias("person_id")))


def checked_carriers(variants: DataFrame, vids: Sequence[str]) -> DataFrame:
    """Carrier ids for use as a join side: counted once, then broadcast or sort-merged."""
    return broadcast_if_small(carriers(variants, vids))


def keep_members(df: DataFrame, ids: DataFrame, key: str = "person_id") -> DataFrame:
    """Rows whose key is in ``ids``. They may repeat; if one may do so often, make them distinct."""
    return df.join(ids, key, "left_semi")


def drop_members(df: DataFrame, ids: DataFrame, key: str = "person_id") -> DataFrame:
    """Rows whose key is not in ``ids``; rows without a key are kept."""
    return df.join(ids, key, "left_anti")


def drop_members_via_left(df: DataFrame, ids: DataFrame, key: str = "person_id") -> DataFrame:
    """The same by another route: left join to marked ids, keep the unmarked rows."""
    marked = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(marked, key, "left").filter(F.col("__hit").isNull()).drop("__hit")


def not_in(df: DataFrame, ids: DataFrame, key: str = "person_id", ids_key: str = "person_id") -> DataFrame:
    """SQL ``NOT IN``: a NULL in a non-empty list, or a NULL key against one, matches nothing.

    SQL text would make Spark broadcast the whole list whatever its size. Here one value from
    the list (all known, or NULL for an empty list) decides the NULL rules, and an ordinary anti
    join, sized by the planner, does the rest.
    """
    all_known = ids.agg(F.bool_and(F.col(ids_key).isNotNull())).scalar()
    passes = F.when(F.col(key).isNotNull(), F.coalesce(all_known, F.lit(True))).otherwise(all_known.isNull())
    renamed = ids.select(F.col(ids_key).alias(key))
    return df.filter(passes).join(renamed, key, "left_anti")


def membership_flag(df: DataFrame, ids: DataFrame, flag: str, key: str = "person_id") -> DataFrame:
    """Add a 0/1 column saying whether the key is in ``ids``; never NULL.

    Meant for frames with one row per key, or few. A broadcast list shuffles nothing.
    """
    marked = ids.select(key).distinct().withColumn(flag, F.lit(1))
    columns = [F.col(c) for c in df.columns if c != flag]
    return (df.drop(flag).join(marked, key, "left")
              .select(*columns, F.coalesce(F.col(flag), F.lit(0)).alias(flag)))


def ids_in_both(left: DataFrame, right: DataFrame, key: str = "person_id") -> DataFrame:
    """Ids present in both frames, each once; folded before they are brought together."""
    return left.select(key).distinct().intersect(right.select(key).distinct())


def ids_missing(left: DataFrame, right: DataFrame, key: str = "person_id") -> DataFrame:
    """Ids of ``left`` that ``right`` lacks, each once; folded before they are brought together."""
    return left.select(key).distinct().subtract(right.select(key).distinct())


def single_row_groups(df: DataFrame, keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """Rows that are alone in their group; larger groups are dropped entirely.

    An aggregate instead of a window: in a group of one, ``first`` *is* the row, and map-side
    combining folds a huge group to one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
              .filter(F.col("__n") == 1).select(*df.columns))

"""Exact distinct people as bitmaps, which merge: one pass over the rows serves every coarser grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.counts import count_by
from cohortloom.operators.ranking import ascending, row_numbers

BUCKET = "__bucket"


def dense_ids(df: DataFrame, key: str = "person_id", name: str = "dense_id") -> DataFrame:
    """Each distinct ``key`` with a number from 1 without gaps.

    A bitmap holds 32,768 neighbouring ids, so ids that lie far apart should be numbered first.
    """
    return row_numbers(df.select(key).filter(F.col(key).isNotNull()).distinct(), ascending(key), name).withColumn(name, F.col(name).cast("bigint"))


def bitmaps(df: DataFrame, by: Sequence[str] = (), key: str = "person_id", name: str = "people") -> DataFrame:
    """One bitmap per group and block of ids. Tasks fold their own rows first, so a hot person or group is one bit
    or a few bitmaps per task. Missing ids are in none."""
    known = df.filter(F.col(key).isNotNull())
    return known.groupBy(*by, F.bitmap_bucket_number(key).alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias(name))


def size(name: str = "people") -> Column:
    """Ids in the bitmaps of a group."""
    return F.coalesce(F.sum(F.bitmap_count(name)), F.lit(0))


def people_by(df: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str], key: str = "person_id",
              name: str = "n_people") -> DataFrame:
    """Distinct ids for each of several groupings of ``by``; a column that a grouping leaves out is NULL.

    ``level`` is the grouping's bit mask (as ``grouping_id``): it tells a total from a missing value. The rows behind
    ``df`` are aggregated once; coarser groupings merge the bitmaps.
    """
    merged = (bitmaps(df, by).groupingSets([[*s, BUCKET] for s in sets], *by, BUCKET)
              .agg(F.bitmap_or_agg("people").alias("people"), F.grouping_id().alias("level")))
    return merged.groupBy(*by, F.shiftright("level", 1).alias("level")).agg(size().alias(name))


def distinct_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: distinct keys, distinct values (NULL is one of each) and rows.

    Two folding aggregations, each over one column, instead of rows written once per distinct count.
    """
    values = count_by(df, value).agg(F.count(F.lit(1)).alias("n_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    keys = bitmaps(df, (), key).agg(size().alias("n")).scalar()
    missing = df.agg(F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))).scalar()
    return values.select((keys + missing).alias("n_keys"), "n_values", "n_rows")

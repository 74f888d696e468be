"""Row numbers over a whole table without sending it through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICES = 128


def ascending(*columns: str | Column, nulls_first: bool = False) -> Column:
    """A sort key of several columns as one value that compares like them."""
    parts = []
    for i, c in enumerate(columns):
        c = F.col(c) if isinstance(c, str) else c
        parts += [(c.isNotNull() if nulls_first else c.isNull()).alias(f"n{i}"), c.alias(f"v{i}")]
    return F.struct(*parts)


def row_numbers(df: DataFrame, key: Column, name: str = "row_number", slices: int = _SLICES) -> DataFrame:
    """Add the position of each row in the order of ``key`` (see ``ascending``), from 1.

    The keys with the lowest hashes, at most ``slices - 1``, cut the order into slices of about equal
    size. A window numbers each slice, and the sizes of the slices before it are added. Cuts and sizes
    are scalar subqueries on the rows' own values, so the plan stays lazy and a recomputed task
    gets the same numbers; ties are numbered in any order.
    """
    rows = df.withColumn("__key", key)
    cuts = (rows.select("__key").distinct().orderBy(F.xxhash64("__key"), "__key").limit(slices - 1)
                .agg(F.sort_array(F.collect_list("__key"))).scalar())
    rows = rows.withColumn("__cuts", cuts).withColumn("__slice", F.size(F.filter("__cuts", lambda cut: cut <= F.col("__key"))))
    rows = rows.drop("__cuts")
    sizes = (rows.groupBy("__slice").agg(F.count(F.lit(1)).alias("n"))
                 .agg(F.collect_list(F.struct(F.col("__slice").alias("slice"), "n"))).scalar())
    rows = rows.withColumn("__sizes", sizes)
    before = F.aggregate(F.filter("__sizes", lambda s: s["slice"] < F.col("__slice")), F.lit(0).cast("bigint"),
                         lambda total, s: total + s["n"])
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy("__key"))
    return rows.select(*[F.col(_quoted(c)) for c in df.columns], (inside + before).alias(name))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

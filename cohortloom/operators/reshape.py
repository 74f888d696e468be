"""List cells: several answers per person and question, unnested side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = 1 << 16


def widen_lists(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
                names: Sequence[int | str], weight: str | None = None) -> DataFrame:
    """Long to wide with several values per cell, unnested in parallel; ``n`` = row multiplicity.

    A single value is recycled along the longest list of its row, a missing cell is NULL, and
    lists of other unequal lengths are an error. No list is ever built. Equal values are
    counted, the counts laid end to end as runs over row positions, and the runs of the columns
    overlaid: a column changes value where one of its runs starts and keeps it until the next.
    So a person with a billion equal answers is a handful of rows here. Values of a cell are
    taken in sort order, missing values first.
    """
    runs = (df.filter(F.col(names_from).isin(list(names)))
              .groupBy(*ids, names_from, values_from)
              .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
              .repartition(*ids))  # one exchange serves the windows and the aggregate below
    in_cell = Window.partitionBy(*ids, names_from)
    in_row = Window.partitionBy(*ids)
    runs = (runs
            .withColumn("__start", F.sum("__n").over(in_cell.orderBy(F.col(values_from).asc_nulls_first())
                                                     .rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
            .withColumn("__length", F.sum("__n").over(in_cell))
            .withColumn("__rows", F.max("__length").over(in_row)))
    fits = (F.col("__length") == 1) | (F.col("__length") == F.col("__rows"))
    runs = runs.withColumn("__rows", F.when(fits, F.col("__rows")).otherwise(
        F.raise_error(F.lit("list cells of one row have unequal lengths")).cast("bigint")))

    # A struct tells "value is NULL" from "no run starts here".
    starts = runs.groupBy(*ids, "__start").agg(
        F.max("__rows").alias("__rows"),
        *[F.max(F.when(F.col(names_from) == n, F.struct(F.col(values_from).alias("v")))).alias(str(n))
          for n in names])
    along = in_row.orderBy("__start")
    until_here = along.rowsBetween(Window.unboundedPreceding, 0)
    following = F.coalesce(F.lead("__start").over(along), F.col("__rows"))
    return starts.select(
        *ids,
        *[F.last(F.col(f"`{n}`"), ignorenulls=True).over(until_here).getField("v").alias(str(n)) for n in names],
        (following - F.col("__start")).alias("n"))


def repeat_rows(df: DataFrame, times: str = "n") -> DataFrame:
    """Each row ``times`` over.

    Rows of up to a chunk are repeated where they lie, without a shuffle. Larger multiplicities are cut into
    chunks that are spread over tasks first, so that no long array is built and no task writes them alone.
    """
    rest = [f"`{c}`" for c in df.columns if c != times]
    few = df.filter(F.col(times).between(1, _CHUNK)).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    many = df.filter(F.col(times) > _CHUNK)
    chunks = many.withColumn("__from", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / _CHUNK))))
    chunks = chunks.repartition(F.xxhash64(*rest), F.col("__from"))
    size = F.least(F.col(times) - F.col("__from") * _CHUNK, F.lit(_CHUNK))
    spread = chunks.withColumn("__i", F.explode(F.sequence(F.lit(1), size.cast("int"))))
    return few.select(*rest).union(spread.select(*rest))

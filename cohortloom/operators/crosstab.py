"""Category x group crosstabs with totals and report order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.functions.labels import level_rank
from cohortloom.functions.text import split_first
from cohortloom.operators.counts import count_by, total_of
from cohortloom.operators.joins import key_join
from cohortloom.operators.ranking import ascending, row_numbers

_LAST = 2_147_483_647


def cells(df: DataFrame, category: str = "category", group: str = "race_ethnicity",
          weight: str | None = None) -> DataFrame:
    """Rows per (category, group): everything after this works on table-sized data."""
    return count_by(df, category, group, name="count", weight=weight)


def _column_sums(group: str, groups: Sequence[str | None]) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col(group).eqNullSafe(F.lit(g)), F.col("count"))), F.lit(0))
             .alias("NA" if g is None else g) for g in groups]


def _pivoted(df: DataFrame, keys: Sequence[str], group: str, value: Column) -> DataFrame:
    """One column per label by Spark's ``pivot``; NULL's column is ``NA`` and comes last."""
    try:
        table = df.withColumn(group, F.coalesce(group, F.lit("NA"))).groupBy(*keys).pivot(group).agg(value)
    except AnalysisException as e:
        if "spark.sql.pivotMaxValues" not in str(e):
            raise
        raise ValueError(f"too many distinct values of {group!r} for columns; the long form has no limit") from e
    return table.select(*keys, *[_quoted(c) for c in sorted(table.columns[len(keys):], key=lambda c: c == "NA")])


def wide(counted: DataFrame, groups: Sequence[str] | None = None, category: str = "category",
         group: str = "race_ethnicity") -> DataFrame:
    """One row per category, one count column per group, empty cells 0.

    Groups that are not given become columns by Spark's ``pivot``, which looks them up and has a
    limit for columns; ``filled`` has the same cells as rows, without any.
    """
    if groups is not None:
        return counted.groupBy(category).agg(*_column_sums(group, groups))
    table = _pivoted(counted, [category], group, F.sum("count"))
    return table.fillna(0, [c for c in table.columns if c != category])


def labels_of(counted: DataFrame, group: str = "race_ethnicity") -> Column:
    """All labels of the cells, NULL included, as one array: a scalar subquery, so the plan stays lazy."""
    return counted.agg(F.collect_set(F.struct(F.col(group).alias("label")))).scalar()


def filled(counted: DataFrame, category: str = "category", group: str = "race_ethnicity") -> DataFrame:
    """The cells with a row for every category and label, empty ones with count 0."""
    every = (counted.select(category).distinct()
                    .select(category, F.explode(labels_of(counted, group)).alias("__label"))
                    .select(category, F.col("__label.label").alias(group)))
    both = key_join(every, counted.select(category, group, "count"), [category, group], "left", null_safe=True)
    return both.fillna(0, ["count"])


def long_totals(counted: DataFrame, category: str = "category", group: str = "race_ethnicity",
                order: Sequence[str] = (), total_row: str = vocab.TOTAL_ROW,
                total_column: str = vocab.TOTAL_COLUMN) -> DataFrame:
    """The crosstab with totals in long form: ``row_number``, category, group, ``count``, zeros included.

    One cube gives the cells, both totals and the corner; the totals' rows carry the names of the
    total row and column. Any number of labels: they are rows here, and the label set is an array
    that one scalar subquery reads off the cells. Listed categories come first in list order, then
    the others in order of first appearance in the group-sorted cells, then the total. Totals count
    answers, not people.
    """
    cube = counted.cube(category, group).agg(
        F.grouping(category).alias("__all_rows"), F.grouping(group).alias("__all_columns"),
        F.min(group).alias("__first"), F.sum("count").alias("count"))
    in_rows, in_columns = F.col("__all_rows") == 0, F.col("__all_columns") == 0
    shown = cube.withColumns({category: F.when(in_rows, F.col(category)).otherwise(F.lit(total_row)),
                              group: F.when(in_columns, F.col(group)).otherwise(F.lit(total_column))})
    # One row per category and for the total, with its position.
    rows = shown.filter(~in_columns & F.col("count").isNotNull())
    rank = F.coalesce(level_rank(F.col(category), order), F.lit(_LAST)) if order else F.lit(_LAST)
    key = ascending("__all_rows", rank, F.when(in_rows, F.col("__first")), F.when(in_rows, F.col(category)))
    rows = row_numbers(rows.select("__all_rows", category, "__first"), key)
    labels = F.concat(F.transform("__labels", lambda s: F.struct(F.lit(0).alias("c"), s["label"].alias("g"))),
                      F.array(F.struct(F.lit(1).alias("c"), F.lit(total_column).alias("g"))))
    grid = rows.withColumn("__labels", labels_of(counted, group)).select("row_number", "__all_rows", category, F.explode(labels).alias("__at"))
    grid = grid.select("row_number", "__all_rows", category, F.col("__at.c").alias("__all_columns"), F.col("__at.g").alias(group))
    cells_ = shown.select("__all_rows", "__all_columns", category, group, "count")
    full = key_join(grid, cells_, ["__all_rows", "__all_columns", category, group], "left", null_safe=True)
    return full.select("row_number", category, group, F.coalesce("count", F.lit(0)).alias("count"), "__all_columns")


def with_totals(counted: DataFrame, groups: Sequence[str] | None = None, category: str = "category",
                group: str = "race_ethnicity", order: Sequence[str] = (),
                total_row: str = vocab.TOTAL_ROW, total_column: str = vocab.TOTAL_COLUMN) -> DataFrame:
    """``long_totals`` with one column per label and the total column last; NULL's column is ``NA``.

    ``groups`` gives the columns; without it, Spark's ``pivot`` looks them up.
    """
    long = long_totals(counted, category, group, order, total_row, total_column)
    keys = ["row_number", category]
    total = F.max(F.when(F.col("__all_columns") == 1, F.col("count"))).alias(total_column)
    if groups is not None:
        cell = lambda g: (F.col("__all_columns") == 0) & F.col(group).eqNullSafe(F.lit(g))
        return long.groupBy(*keys).agg(
            *[F.coalesce(F.max(F.when(cell(g), F.col("count"))), F.lit(0)).alias("NA" if g is None else g) for g in groups], total)
    table = _pivoted(long, keys, group, F.first("count"))
    return table.select(*keys, *[_quoted(c) for c in table.columns if c not in (*keys, total_column)], _quoted(total_column))


def long_counts(table: DataFrame, groups: Sequence[str], category: str = "category",
                group: str = "race_ethnicity") -> DataFrame:
    """Wide counts back to one row per (category, group), zeros included."""
    return table.unpivot([category], list(groups), group, "count")


def split_category(df: DataFrame, category: str = "category", separator: str = ": ",
                   into: tuple[str, str] = ("question_group", "answer")) -> DataFrame:
    """Add the parts of the category before and after the first separator."""
    first, rest = split_first(F.col(category), separator)
    return df.withColumns({into[0]: first, into[1]: rest})


def bar_shares(long: DataFrame, bar: str = "race_ethnicity") -> DataFrame:
    """Proportion of each segment inside its bar, 0 to 1; NULL in an empty bar."""
    return long.withColumn("share", F.col("count") / F.nullif(total_of(long, "count", [bar]), F.lit(0)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

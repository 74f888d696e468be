"""Text helpers for survey answers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import vocab


def na_to_null(value: Column, tokens: Sequence[str] = tuple(vocab.NA_TOKENS)) -> Column:
    """NULL for every token that means "missing" in a text export."""
    return F.when(value.isin(list(tokens)), F.lit(None)).otherwise(value)


def paste(prefix: str, value: Column) -> Column:
    """Join with one space; a missing value is written as ``NA``."""
    return F.concat(F.lit(prefix + " "), F.coalesce(value.cast("string"), F.lit("NA")))


def replace_first(value: Column, literal: str, replacement: str = "") -> Column:
    """Replace the first occurrence only, case-sensitive."""
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(value, "(?s)^(.*?)" + re.escape(literal), "$1" + safe)


def remove_all(value: Column, literals: Iterable[str]) -> Column:
    """Remove every occurrence of any of the literals."""
    return F.regexp_replace(value, "|".join(re.escape(x) for x in literals), "")


def split_first(value: Column, separator: str) -> tuple[Column, Column]:
    """Text before and after the first separator; the second part is NULL without one."""
    parts = F.split(value, re.escape(separator), 2)
    return F.get(parts, 0), F.get(parts, 1)


def to_id(value: Column) -> Column:
    """Id as bigint; text that is no number becomes NULL instead of failing the job."""
    return value.try_cast("bigint")


def cast_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Make several columns ids at once; do it when loading, so that joins compare like with like."""
    return df.withColumns({c: to_id(F.col(c)) for c in columns})

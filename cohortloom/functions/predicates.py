"""Filters whose treatment of NULL differs from plain SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom import vocab


def not_listed(value: Column, unwanted: Sequence[str] = tuple(vocab.REFUSALS)) -> Column:
    """True unless the value is in the list; NULL is kept."""
    return ~F.coalesce(value.isin(list(unwanted)), F.lit(False))


def matches(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Regex search that is false, not NULL, for a missing value."""
    return F.coalesce(value.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def is_valid_answer(value: Column, pattern: str = vocab.INVALID_PATTERN) -> Column:
    """True unless the answer looks like a refusal; a missing answer counts as valid."""
    return ~matches(value, pattern, ignore_case=True)


def is_answered(value: Column) -> Column:
    """Present, not empty and not the token ``NA``."""
    return value.isNotNull() & (value != "") & (value != "NA")

"""Percentages and their two-decimal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as a double."""
    return F.lit(100.0) * part / whole


def fixed2(value: Column) -> Column:
    """Text with exactly two decimals, rounded on the stored binary value, ties to even.

    ``format_number`` with a pattern rounds like C's ``printf``; ``format_string`` and
    ``round`` round the shortest decimal text half-up and differ on many ratios.
    """
    return F.call_function("format_number", value, F.lit("0.00"))


def round2(value: Column) -> Column:
    """The same rounding as a double."""
    return fixed2(value).cast("double")


def count_with_percent(count: Column, share: Column) -> Column:
    """Cell text such as ``12 (34.50%)``."""
    return F.concat(count.cast("string"), F.lit(" ("), fixed2(share), F.lit("%)"))

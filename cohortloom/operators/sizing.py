"""Broadcast decisions: nothing is broadcast without a check of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Count the rows (one distributed job) and hint accordingly.

    For frames whose planned size cannot be trusted: an exploded array is planned at the size
    of the array column, so an estimate may let through a list that does not fit. Up to
    ``max_rows`` narrow rows the frame is broadcast; beyond, a sort-merge join is requested,
    where AQE splits hot keys.
    """
    return F.broadcast(df) if df.count() <= max_rows else df.hint("merge")

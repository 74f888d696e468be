"""SQL text to a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def sql_frame(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None,
              **frames: DataFrame) -> DataFrame:
    """Run SQL with bound values (``:name``) and frames (``{name}``).

    Values are bound, never pasted in: a list goes in as an array for ``array_contains`` and a
    database name through ``IDENTIFIER(:db || '.table')``. 64-bit integers stay 64-bit.
    """
    return spark.sql(text, args=dict(args or {}), **frames)

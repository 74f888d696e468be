"""Normal tail probability, the one expression Spark has no built-in for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a z score. Used on coefficient tables, a few rows per model.

    The function is local, so it travels to the workers by value and needs no package there.
    """

    def tail(scores: pd.Series) -> pd.Series:
        cdf = scores.abs().map(lambda x: 0.5 * math.erfc(-x / math.sqrt(2.0)), na_action="ignore")
        return (1.0 - cdf) * 2.0

    return F.pandas_udf(tail, T.DoubleType())(z)

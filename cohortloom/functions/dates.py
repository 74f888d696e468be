"""Calendar arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = dt.date | str | Column


def as_date(when: AsOf) -> Column:
    """A date column from a date, ISO text or column."""
    return when if isinstance(when, Column) else F.lit(str(when)).cast("date")


def completed_years(birth: Column, as_of: AsOf) -> Column:
    """Birthdays passed at ``as_of``. Explicit date, so a rerun gives the same ages."""
    born, day = F.to_date(birth), as_date(as_of)
    month_day = lambda d: F.month(d) * 100 + F.day(d)
    return F.year(day) - F.year(born) - F.when(month_day(day) < month_day(born), 1).otherwise(0)


def compact_date(when: AsOf) -> Column:
    """``yyyyMMdd`` text."""
    return F.date_format(as_date(when), "yyyyMMdd")

"""Calendar buckets of a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed


def weekday_index(date: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(date)


def holiday_bucket(date: Column, holidays=None) -> Column:
    """Bucket of the holiday period that holds the date, -1 for other days."""
    day = F.dayofyear(date)
    bucket = F.lit(None).cast("int")
    for first, last, number in fixed.HOLIDAYS if holidays is None else holidays:
        bucket = F.coalesce(bucket, F.when(day.between(first, last), F.lit(number)))
    return F.coalesce(bucket, F.lit(-1))


def date_ratio(first: Column, last: Column, n_rows: Column) -> Column:
    """Whole days between first and last date per row; 1.0 where there is one date only."""
    days = F.datediff(last, first)
    return F.when(days > 0, F.floor(days / n_rows).cast("double")).otherwise(F.lit(1.0))

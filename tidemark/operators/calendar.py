"""Future dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours in a step of each frequency; others count as daily.  Months and years are 30 and 365 days.
STEP_HOURS = {"H": 1, "D": 24, "W": 7 * 24, "M": 30 * 24, "Y": 365 * 24}


def future_dates(last: Column, periods: int, freq: str = "D") -> Column:
    """An array of ``periods`` timestamps after ``last``; all but hourly ones drop the time of day."""
    key = freq.upper()
    hours = STEP_HOURS.get(key, 24)
    start = last if key == "H" else F.date_trunc("day", last).cast("timestamp_ntz")
    zero = F.lit(0)
    if periods <= 0:
        return F.array().cast("array<timestamp_ntz>")
    return F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: start + F.make_dt_interval(zero, i * hours, zero, F.lit(0.0).cast("decimal(18,6)")))


def make_future(history: DataFrame, periods: int, freq: str = "D", keys: Sequence[str] = (), include_history: bool = True) -> DataFrame:
    """(keys, ds): the history's rows as they are (repeated ones too), then the future of each series."""
    keys = list(keys)
    lasts = history.groupBy(*keys).agg(F.max("ds").alias("last")).filter(F.col("last").isNotNull())
    future = lasts.select(*keys, F.explode(future_dates(F.col("last"), periods, freq)).alias("ds"))
    return history.select(*keys, "ds").unionByName(future) if include_history else future


def future_dates_daily(last: Column, periods: int) -> Column:
    """Kept for callers of the older name."""
    return future_dates(last, periods, "D")

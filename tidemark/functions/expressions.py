"""Column expressions of the model: time, trend, seasonality, holidays, regressors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORM = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$"


def parse_ds(text: Column) -> Column:
    """Text as a timestamp without zone; null unless it is a date or a date with a time of day."""
    return F.when(F.regexp_like(text, F.lit(DATE_FORM)), text.try_cast("timestamp_ntz"))


def as_ds(column: Column, kind: str) -> Column:
    """A column of Spark type ``kind`` as a timestamp without zone."""
    return parse_ds(column) if kind == "string" else column.cast("timestamp_ntz")


def _diff(unit: str, start: Column, end: Column) -> Column:
    return F.timestamp_diff(unit, start, end)


def seconds_between(start: Column, end: Column) -> Column:
    return _diff("MICROSECOND", start, end) / F.lit(1e6)


def scaled_time(ds: Column, t0: Column, t_scale: Column) -> Column:
    return seconds_between(t0, ds) / t_scale


def days_since(ds: Column, t0: Column) -> Column:
    """Whole seconds since t0, in days: the phase of seasonalities."""
    return _diff("SECOND", t0, ds) / F.lit(86400.0)


def time_scale(first: Column, last: Column) -> Column:
    return F.greatest(seconds_between(first, last), F.lit(1e-12))


def fourier_terms(days: Column, period: float, order: int) -> list[Column]:
    """sin and cos, interleaved, of 1..order periods."""
    angle = [F.lit(2.0 * math.pi * k) * days / F.lit(float(period)) for k in range(1, order + 1)]
    return [f(a) for a in angle for f in (F.sin, F.cos)]


def dot(terms: list[Column], beta: Column) -> Column:
    """Sum of terms times places of ``beta``, unrolled; null where ``beta`` is."""
    total = F.lit(0.0)
    for at, term in enumerate(terms):
        total = total + term * F.get(beta, F.lit(at))
    return total


def holiday_terms(ds: Column, dates: tuple[str, ...], lower: int, upper: int, pooled: bool = False) -> list[Column]:
    """An indicator for each date and day of its window, or for each day of the window of any date; the time of day does not
    count."""
    day = ds.cast("date")
    if pooled:
        return [F.when(F.date_sub(day, offset).isin(*(F.lit(date).cast("date") for date in dates)), 1.0).otherwise(0.0) for offset in range(lower, upper + 1)] if dates else []
    return [F.when(F.datediff(day, F.lit(date).cast("date")) == offset, 1.0).otherwise(0.0) for date in dates for offset in range(lower, upper + 1)]


def changepoint_row(t: Column, t_change: Column) -> Column:
    """A row of the changepoint matrix: 1 for each changepoint up to t."""
    return F.transform(t_change, lambda s: F.when(t >= s, 1.0).otherwise(0.0))


def design_row(*blocks: list[Column]) -> Column:
    """A row of the design matrix: the columns of all blocks side by side."""
    return F.array(*(column for block in blocks for column in block))


def active(t: Column, t_change: Column) -> Column:
    """Number of changepoints up to t, whatever order they stand in."""
    return F.size(F.filter(t_change, lambda s: s <= t))


def running(start: Column, steps: Column) -> Column:
    """Prefix sums: start, start + steps[0], ..."""
    return F.aggregate(steps, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def trend_arrays(params_growth: str, k: Column, m: Column, delta: Column, t_change: Column, gamma: Column) -> tuple[Column, Column]:
    """Rate and offset after each number of changepoints, worked out once for a series."""
    shift = F.zip_with(t_change, delta, lambda s, d: -s * d) if params_growth == "linear" else gamma
    return running(k, delta), running(m, shift)


def piecewise_linear(t: Column, rates: Column, offsets: Column, n: Column) -> Column:
    return F.get(rates, n) * t + F.get(offsets, n)


def piecewise_logistic(t: Column, cap: Column, rates: Column, offsets: Column, n: Column) -> Column:
    return cap / (F.lit(1.0) + F.exp(-F.get(rates, n) * (t - F.get(offsets, n))))


def logistic_gamma(k: Column, m: Column, delta: Column, t_change: Column) -> Column:
    """Offsets that keep a logistic trend continuous at each changepoint."""
    start = F.struct(k.alias("k"), m.alias("m"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        after = acc["k"] + x["delta"]
        ratio = F.when(F.abs(after) <= 1e-12, F.lit(0.0)).otherwise(acc["k"] / after)
        gamma = (x["s"] - acc["m"]) * (F.lit(1.0) - ratio)
        return F.struct(after.alias("k"), (acc["m"] + gamma).alias("m"), F.array_append(acc["out"], gamma).alias("out"))

    pairs = F.zip_with(t_change, delta, lambda s, d: F.struct(s.alias("s"), d.alias("delta")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])

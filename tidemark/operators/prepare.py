"""Preparation of training data: coercion, filters, checks and scales for each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TIERS, Config
from tidemark.errors import DataValidationError
from tidemark.functions import expressions as X
from tidemark.operators import starts
from tidemark.schema import FORECAST_COLUMNS, PARAMS

RESERVED = {*PARAMS.names, *FORECAST_COLUMNS, "y", "cap", "floor", "weight"}


def require(df: DataFrame, config: Config, keys: Sequence[str] = (), training: bool = True) -> None:
    """Schema checks; none of them runs a job."""
    have = set(df.columns)
    if "ds" not in have or (training and "y" not in have):
        raise DataValidationError("DataFrame must have 'ds' and 'y' columns" if training else "DataFrame must have a 'ds' column")
    for key in keys:
        if key not in have:
            raise DataValidationError(f"Column '{key}' not found")
        if key in RESERVED:
            raise DataValidationError(f"Key column '{key}' has the name of a column of the params or the forecast")
    for regressor in config.regressors:
        if regressor.name not in have:
            raise DataValidationError(f"Regressor '{regressor.name}' not found in the DataFrame")
    kinds = dict(df.dtypes)
    for seasonality in config.seasonalities:
        if (name := seasonality.condition_name) is not None:
            if name not in have:
                raise DataValidationError(f"Condition column '{name}' not found in the DataFrame")
            if kinds[name] != "boolean":
                raise DataValidationError(f"Condition column '{name}' must be boolean")


def coerce(df: DataFrame, config: Config, keys: Sequence[str] = (), training: bool = True) -> DataFrame:
    """Keys, ds as a timestamp without zone, and what the model uses, as doubles or booleans; all else is dropped."""
    require(df, config, keys, training)
    kinds = dict(df.dtypes)
    optional = [c for c in ("cap", "floor", *(("weight",) if training else ())) if c in kinds]
    conditions = [x.condition_name for x in config.seasonalities if x.condition_name]
    return df.select(
        *keys,
        X.as_ds(F.col("ds"), kinds["ds"]).alias("ds"),
        *([F.col("y").cast("double").alias("y")] if training else []),
        *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*optional, *(x.name for x in config.regressors)])),
        *dict.fromkeys(conditions),
    )


def drop_null_y(df: DataFrame) -> DataFrame:
    return df.filter(F.col("y").isNotNull() & ~F.isnan("y"))


def min_rows_error(n: Column) -> Column:
    return F.when(n < 2, F.lit("Dataframe has less than 2 non-NaN rows"))


def series_checks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each series: n_obs and, where columns are there, the first bad ds of cap and floor and whether a weight is negative."""
    aggs = [F.count("*").alias("n_obs")]
    if "weight" in df.columns:
        aggs.append(F.coalesce(F.bool_or(F.col("weight") < 0), F.lit(False)).alias("negative_weight"))
    if "cap" in df.columns:
        low = F.coalesce("floor", F.lit(0.0)) if "floor" in df.columns else F.lit(0.0)
        aggs.append(F.min(F.when(F.col("cap") <= low, F.col("ds"))).alias("bad_cap_ds"))
    return df.groupBy(*keys).agg(*aggs)


def distinct_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def series_summary(df: DataFrame, keys: Sequence[str], value: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def scales(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each series: t0, t_last, t_scale, y_scale, whole days spanned, yearly gate, number of rows."""
    low = F.coalesce("floor", F.lit(0.0)) if "floor" in df.columns else F.lit(0.0)
    first, last = F.min("ds"), F.max("ds")
    return df.groupBy(*keys).agg(
        first.alias("t0"),
        last.alias("t_last"),
        X.time_scale(first, last).alias("t_scale"),
        F.greatest(F.max(F.abs(F.col("y") - low)), F.lit(1.0)).alias("y_scale"),
        F.timestamp_diff("DAY", first, last).alias("span_days"),
        (F.timestamp_diff("DAY", first, last) >= 730).alias("yearly"),
        F.count("*").alias("n_obs"),
    )


def regressor_stats(df: DataFrame, keys: Sequence[str], name: str, standardize: str = "auto") -> DataFrame:
    """mu and std (1 at least) of a regressor; 0 and 1 where it is not standardised (0/1 values, or a constant)."""
    x = F.col(name).cast("double")
    binary = F.bool_and(x.isin(0.0, 1.0)) & (F.min(x) == 0.0) & (F.max(x) == 1.0)
    constant = F.min(x) == F.max(x)
    plain = {"auto": binary | constant, "true": constant, "false": F.lit(True)}[standardize]
    return df.groupBy(*keys).agg(
        F.when(plain, 0.0).otherwise(F.avg(x)).alias("mu"),
        F.when(plain, 1.0).otherwise(F.greatest(F.stddev_pop(x), F.lit(1.0))).alias("std"),
    )


def train_test_split(df: DataFrame, keys: Sequence[str], test_rows: int) -> DataFrame:
    """``df`` with a column is_test: the last rows of each series."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    return df.withColumn("is_test", F.row_number().over(w) <= test_rows)


def changepoint_places(n_obs: Column, count: int, share: float) -> Column:
    """Row numbers (from 0) of automatic changepoints, as an array."""
    end = F.floor((n_obs - 1) * F.lit(float(share))).cast("int")
    place = lambda i: F.least(F.greatest(F.round(i * end / F.lit(float(count + 1))).cast("int"), F.lit(1)), end - 1)
    none = F.array().cast("array<int>")
    if count == 0:
        return none
    return F.when((n_obs <= 2) | (end <= 1), none).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(count)), place)))


def auto_changepoints(df: DataFrame, keys: Sequence[str], count: int = 15, share: float = 0.8) -> DataFrame:
    """(keys, place, t): the scaled times of the automatic changepoints; equal times count once."""
    w = Window.partitionBy(*keys)
    rows = df.select(*keys, "ds", (F.row_number().over(w.orderBy("ds")) - 1).alias("place"), F.count("*").over(w).alias("n"), F.min("ds").over(w).alias("t0"), F.max("ds").over(w).alias("t_last"))
    rows = rows.filter(F.array_contains(changepoint_places(F.col("n"), count, share), F.col("place")))
    t = X.scaled_time(F.col("ds"), F.col("t0"), X.time_scale(F.col("t0"), F.col("t_last")))
    return rows.select(*keys, "place", t.alias("t")).groupBy(*keys, "t").agg(F.min("place").cast("bigint").alias("place"))


def manual_changepoints(scaled: DataFrame, keys: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """(keys, t) of given dates inside the history; bad dates are skipped."""
    parsed = F.transform(F.array(*(F.lit(str(d)) for d in dates)), lambda d: F.struct(d.alias("d"))) if dates else F.array().cast("array<struct<d:string>>")
    rows = scaled.select(*keys, "t0", "t_scale", F.explode(parsed).alias("p"))
    t = X.scaled_time(X.parse_ds(F.col("p.d")), F.col("t0"), F.col("t_scale"))
    return rows.select(*keys, t.alias("t")).filter(F.col("t").between(0.0, 1.0)).distinct()


def adaptive(n_obs: Column, count: int, scale: float) -> tuple[Column, Column]:
    """Number of changepoints and prior scale after tuning by length, as columns."""
    n, tau = F.lit(count), F.lit(float(scale))
    for rows, most, largest in reversed(TIERS):
        n, tau = F.when(n_obs >= rows, min(count, most)).otherwise(n), F.when(n_obs >= rows, min(scale, largest)).otherwise(tau)
    return n, tau


def ends(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last scaled y (and cap) of each series, for the starting values of trends."""
    cap = "cap" if "cap" in df.columns else None
    own = [F.min_by("ys", "ds").alias("y0"), F.max_by("ys", "ds").alias("y1"), F.avg("ys").alias("mean")]
    if cap:
        own += [F.min_by("cs", "ds").alias("c0"), F.max_by("cs", "ds").alias("c1")]
    return df.groupBy(*keys).agg(*own)


def y_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the scaled y of each series; the mean is the level of a flat trend."""
    return df.groupBy(*keys).agg(F.avg("ys").alias("mean"), F.stddev_pop("ys").alias("std"))


def total_weight(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sum of weights of each series; a missing weight is 1."""
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    return df.groupBy(*keys).agg(F.sum(weight).alias("weight"))


def sigma_start(df: DataFrame, keys: Sequence[str], trend: Column) -> DataFrame:
    """The bounded deviation of the scaled y from ``trend``."""
    low, high = map(F.lit, starts.SIGMA_BOUNDS)
    return df.groupBy(*keys).agg(F.least(F.greatest(F.stddev_pop(F.col("ys") - trend), low), high).alias("sigma"))


def delta_start(df: DataFrame, keys: Sequence[str], t_change: Sequence[float]) -> DataFrame:
    """(keys, j, delta) of rows (keys, ds, t, ys): the slope after each changepoint less that before it, bounded."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ds")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy(*keys))
    size = F.least(F.greatest(F.floor(F.col("n") / starts.WINDOW_SHARE), F.lit(starts.WINDOW[0])), F.lit(starts.WINDOW[1]))
    rows = df.select(*keys, "t", "ys", (F.row_number().over(w) - 1).alias("i"), n.alias("n"), (F.last("ys").over(whole) - F.first("ys").over(whole)).alias("k")).withColumn("w", size)
    points = rows.select(*keys, "i", "t", "ys")
    places = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(s).alias("s")) for j, s in enumerate(t_change)))
    at = rows.select(*keys, "n", "w", "k", "i", "t", F.inline(places)).filter("t >= s").groupBy(*keys, "j", "n", "w", "k").agg(F.min("i").alias("at")).filter("at > 0 AND at < n - 1")
    for name, place in (("b1", F.col("at") - 1), ("b0", F.greatest(F.col("at") - F.col("w"), F.lit(0))), ("a0", F.col("at")), ("a1", F.least(F.col("at") + F.col("w"), F.col("n")) - 1)):
        own = points.select(*keys, F.col("i").alias("_i"), F.col("t").alias(f"t{name}"), F.col("ys").alias(f"y{name}"))
        at = at.withColumn("_i", place.cast("int")).join(own, [*keys, "_i"]).drop("_i")
    slope = lambda x: (F.col(f"y{x}1") - F.col(f"y{x}0")) / (F.col(f"t{x}1") - F.col(f"t{x}0"))
    most = F.abs("k") * starts.MOST_DELTA[0] + starts.MOST_DELTA[1]
    return at.select(*keys, "j", F.least(F.greatest(slope("a") - slope("b"), -most), most).alias("delta"))


def logistic_start(y0: Column, y1: Column, c0: Column, c1: Column, span: Column, mean: Column) -> tuple[Column, Column]:
    """(k, m) of a logistic trend through the first and last point."""
    inside = lambda y, c: F.greatest(F.lit(0.01) * c, F.least(F.lit(0.99) * c, y))
    r0, r1 = c0 / inside(y0, c0), c1 / inside(y1, c1)
    r0 = F.when(F.abs(r0 - r1) <= 0.01, F.lit(1.05) * r0).otherwise(r0)
    l0, l1 = F.log(r0 - 1), F.log(r1 - 1)
    k = F.when(span <= 0, F.lit(0.0)).otherwise((l0 - l1) / span)
    m = F.when(span <= 0, mean).otherwise(l0 * span / (l0 - l1))
    return k, m

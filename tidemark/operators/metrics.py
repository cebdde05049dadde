"""Forecast errors and back-tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import fitting, predicting, prepare


def errors(df: DataFrame, keys: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """rmse, mae, r2 and number of rows of each series; sums of squares are pre-aggregated in one pass."""
    e = F.col(y) - F.col(yhat)
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return sums.select(*keys, "n", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, largest and relative absolute difference of two forecasts."""
    both = a.select(*keys, "ds", F.col("yhat").alias("p")).join(b.select(*keys, "ds", F.col("yhat").alias("q")), [*keys, "ds"])
    d = F.abs(F.col("p") - F.col("q"))
    return both.groupBy(*keys).agg(F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), (F.avg(d) / F.avg(F.abs("p"))).alias("relative"))


def backtest(df: DataFrame, config: Config, cutoffs: Sequence[str], horizon_days: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cutoff, ds, y, yhat): rolling origins.  All cutoffs are fitted in one job, grouped by series and cutoff."""
    own = [*keys, "cutoff"]
    rows = prepare.coerce(df, config, keys)
    origins = F.array(*(F.lit(str(c)).cast("timestamp_ntz") for c in cutoffs))
    dealt = rows.withColumn("cutoff", F.explode(origins))
    history = dealt.filter(F.col("ds") <= F.col("cutoff"))
    window = dealt.filter((F.col("ds") > F.col("cutoff")) & (F.col("ds") <= F.col("cutoff") + F.make_dt_interval(F.lit(horizon_days))))
    params = fitting.fit(history, config, own)  # read once, so not kept; a row for each series and cutoff
    ahead = predicting.predict(window, params, config, own, small=False)
    return ahead.select(*own, "ds", "yhat").join(window.select(*own, "ds", "y"), [*own, "ds"])

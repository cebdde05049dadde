"""Forecasts of a stream: prediction keeps no state, so it is a stream-static join with the params."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import predicting, prepare


def score_stream(stream: DataFrame, params: DataFrame, config: Config, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast rows of a streaming frame as they arrive, in append mode."""
    return predicting.predict(prepare.coerce(stream, config, keys, training=False), params, config, keys, small=None)


def hourly_series(stream: DataFrame, ts: str, value: str, keys: Sequence[str] = (), late: str = "2 hours") -> DataFrame:
    """(keys, ds, y): sums by hour of an event stream; events later than ``late`` are left out."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *keys).agg(F.sum(value).alias("y"))
    return rows.select(*keys, F.col("window.start").alias("ds"), "y")

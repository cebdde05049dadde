"""The params table as a model store: Parquet or JSON tables, and single models as JSON text."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import PARAMS


def to_json(params: DataFrame) -> DataFrame:
    """A single column ``model``: each params row as JSON text, without loss."""
    return params.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("model"))


def from_json(texts: DataFrame, keys: Sequence[T.StructField] = ()) -> DataFrame:
    """Params rows of a column ``model``; fields that are missing get their defaults."""
    schema = T.StructType([*keys, *PARAMS.fields])
    rows = texts.select(F.from_json("model", schema).alias("p")).select("p.*")
    empty = F.array().cast("array<double>")
    defaults = {
        "growth": F.lit("linear"), "n_changepoints": F.lit(15), "changepoint_range": F.lit(0.8), "changepoint_prior_scale": F.lit(0.05), "seasonality_mode": F.lit("additive"), "interval_width": F.lit(0.8),
        "t_scale": F.lit(1.0), "y_scale": F.lit(1.0), "logistic_floor": F.lit(False), "t_change": empty, "delta": empty, "gamma": empty, "beta": empty, "sigma_obs": F.lit(0.0), "features": F.array().cast(PARAMS["features"].dataType),
    }
    return rows.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})


def save(params: DataFrame, path: str, format: str = "parquet") -> None:
    if format == "json":
        to_json(params).withColumnRenamed("model", "value").write.mode("overwrite").text(path)
    else:
        params.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, format: str = "parquet", keys: Sequence[T.StructField] = ()) -> DataFrame:
    if format == "json":
        return from_json(spark.read.text(path).withColumnRenamed("value", "model"), keys)
    return spark.read.parquet(path)


def as_dict(row: Row) -> dict:
    """A params row as plain values; timestamps as text."""
    plain = lambda v: v.isoformat(sep=" ") if isinstance(v, (dt.datetime, dt.date)) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
    return plain(row.asDict(recursive=True))


def row_to_text(row: Row) -> str:
    return json.dumps(as_dict(row))

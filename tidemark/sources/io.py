"""Reading series and writing forecasts in any format that Spark knows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_frame(spark: SparkSession, data: DataFrame | pd.DataFrame) -> DataFrame:
    """A Spark frame as it is, a pandas one or one that turns into it (polars) as a Spark one; else a TypeError.

    The ds of a frame in memory has no zone.
    """
    if not isinstance(data, pd.DataFrame) and not hasattr(data, "sparkSession") and hasattr(data, "to_pandas"):
        data = data.to_pandas()
    if isinstance(data, pd.DataFrame):
        df = spark.createDataFrame(data)
        return df.withColumn("ds", F.col("ds").cast("timestamp_ntz")) if dict(df.dtypes).get("ds") == "timestamp" else df
    if not hasattr(data, "sparkSession"):
        raise TypeError(f"expected a Spark or pandas DataFrame, not {type(data).__name__}")
    return data


def read_series(spark: SparkSession, path: str, columns: Mapping[str, str], format: str = "parquet", **options) -> DataFrame:
    """A table with its columns named as the engine wants them; ``columns`` maps ds, y, keys, ... to the table's names.

    Only these columns are read where the format allows it.
    """
    rows = spark.read.format(format).options(**options).load(path)
    return rows.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def write_forecast(forecast: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite", **options) -> None:
    forecast.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """One line for each series that could not be fitted."""
    keys = [c for c in errors.columns if c != "error"]
    errors.select(F.concat_ws(": ", F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)), "error").alias("value")).write.mode("overwrite").text(path)

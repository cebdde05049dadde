"""The user's surface: a configured forecaster, fitted to one series or to many."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Config, Holiday, Regressor, Seasonality, as_dates
from tidemark.errors import DataValidationError, PredictionError
from tidemark.operators import calendar, fitting, gram, predicting, prepare
from tidemark.schema import PARAMS
from tidemark.sources import io, store

#: Bytes (as planned) and rows beyond which a single series is not gathered in one worker.
LARGE_BYTES, LARGE_ROWS = 64 << 20, 1_000_000


def _planned_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class Forecaster:
    """Options as in :class:`tidemark.config.Config`; ``uncertainty_samples`` is accepted and has no effect."""

    def __init__(self, growth: str = "linear", n_changepoints: int = 15, changepoint_range: float = 0.8, changepoint_prior_scale: float = 0.05, yearly_seasonality: bool = True, weekly_seasonality: bool = True, daily_seasonality: bool = False, seasonality_mode: str = "additive", interval_width: float = 0.8, uncertainty_samples: int = 1000, changepoints: Sequence | None = None, pool_holidays: bool = False):
        del uncertainty_samples
        self.config = Config(growth, n_changepoints, changepoint_range, changepoint_prior_scale, yearly_seasonality, weekly_seasonality, daily_seasonality, seasonality_mode, interval_width, None if changepoints is None else tuple(changepoints), pool_holidays=pool_holidays)

    def __repr__(self) -> str:
        return f"{type(self).__name__}(growth={self.config.growth!r}, n_changepoints={self.config.n_changepoints})"

    @property
    def trend_type(self) -> str:
        return self.config.growth

    @property
    def n_changepoints(self) -> int:
        return self.config.n_changepoints

    def add_seasonality(self, name: str, period: float, fourier_order: int, prior_scale: float = 10.0, mode: str = "additive", condition_name: str | None = None) -> Forecaster:
        self.config = self.config.with_seasonality(Seasonality(name, period, fourier_order, prior_scale, mode, condition_name))
        return self

    def add_holidays(self, name: str, dates: Sequence, lower_window: int = 0, upper_window: int = 0, prior_scale: float = 10.0, mode: str = "additive") -> Forecaster:
        self.config = self.config.with_holiday(Holiday(name, as_dates(dates), lower_window, upper_window, prior_scale, mode))
        return self

    def add_country_holidays(self, name: str, calendar: DataFrame | None = None) -> Forecaster:
        """Notes the country; with a calendar (country, holiday, ds) its days become holidays too (a bounded list)."""
        self.config = replace(self.config, countries=(*self.config.countries, name))
        if calendar is not None:
            own = calendar.filter(F.col("country") == name).groupBy("holiday").agg(F.array_sort(F.collect_set(F.col("ds").cast("string"))).alias("dates"))
            for row in own.orderBy("holiday").collect():
                self.add_holidays(row["holiday"], row["dates"])
        return self

    def add_regressor(self, name: str, prior_scale: float = 10.0, standardize: str | bool = "auto", mode: str | None = None) -> Forecaster:
        self.config = self.config.with_regressor(Regressor(name, prior_scale, str(standardize).lower(), mode or self.config.seasonality_mode))
        return self

    def get_regressor_names(self) -> list[str]:
        return [x.name for x in self.config.regressors]

    def get_condition_names(self) -> list[str]:
        return [x.condition_name for x in self.config.seasonalities if x.condition_name]

    def fit(self, df, keys: Sequence[str] = ()) -> FittedForecaster:
        """Fits each series of a Spark, pandas or polars frame.

        A single series that cannot be fitted raises; of many, each failure is a row.  A single series that may not fit one
        worker (by the planner's estimate of its bytes, then by its rows) is fitted from sums over the cluster, where the
        model allows it.
        """
        df = io.as_frame(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), df)
        rows = prepare.coerce(df, self.config, keys)
        if not keys and fitting.is_exact(self.config) and _planned_bytes(rows) > LARGE_BYTES and rows.count() > LARGE_ROWS:
            try:
                return FittedForecaster(self.config, gram.fit_large_params(df, self.config), rows, keys, n_success=1)
            except ValueError as error:
                raise DataValidationError(str(error)) from error
        params = fitting.fit(df, self.config, keys).cache()  # the fit is what costs; later actions read it
        fitted = FittedForecaster(self.config, params, rows, keys)
        if not keys:
            row = params.first()
            fitted.n_success = 1
            if row is None:
                raise DataValidationError("Dataframe has less than 2 non-NaN rows")
            if row["error"] is not None:
                raise DataValidationError(row["error"])
        return fitted


class FittedForecaster:
    def __init__(self, config: Config, params: DataFrame, history: DataFrame | None, keys: Sequence[str] = (), n_success: int | None = None):
        self.config, self.params_df, self.history, self.keys = config, params, history, list(keys)
        if n_success is not None:
            self.n_success = n_success

    def __repr__(self) -> str:
        return f"{type(self).__name__}(growth={self.config.growth!r}, keys={self.keys!r})"

    @property
    def errors_df(self) -> DataFrame:
        return self.params_df.filter(F.col("error").isNotNull()).select(*self.keys, "error")

    def unpersist(self) -> None:
        """Give back the memory that the params take; they are fitted anew if they are used again."""
        self.params_df.unpersist()

    @cached_property
    def n_success(self) -> int:
        return self.params_df.filter(F.col("error").isNull()).count()

    @property
    def n_failed(self) -> int:
        return self.params_df.filter(F.col("error").isNotNull()).count()

    def summary(self) -> str:
        counts = self.params_df.agg(F.count_if(F.col("error").isNull()), F.count("*")).first()
        return f"Fitted {counts[0]}/{counts[1]} series successfully"

    def _row(self, *key):
        rows = self.params_df
        for name, value in zip(self.keys, key, strict=True):
            rows = rows.filter(F.col(name) == value)
        return rows.first()

    def model(self, *key) -> dict | None:
        """The params of a series; None if there is none or it failed."""
        row = self._row(*key)
        return None if row is None or row["error"] is not None else store.as_dict(row)

    params = model

    def error(self, *key) -> str | None:
        row = self._row(*key)
        return None if row is None else row["error"]

    def make_future(self, periods: int, freq: str = "D", include_history: bool = True) -> DataFrame:
        if self.history is None:
            lasts = self.params_df.filter(F.col("error").isNull()).select(*self.keys, F.col("t_last").alias("ds"))
            return calendar.make_future(lasts, periods, freq, self.keys, False)
        return calendar.make_future(prepare.drop_null_y(self.history), periods, freq, self.keys, include_history)

    make_future_dataframe = make_future

    def predict(self, df: DataFrame | None = None, periods: int | None = None, freq: str = "D", include_history: bool = False) -> DataFrame:
        """Forecasts of ``df``, of ``periods`` future steps, or (for a single series) of the training rows."""
        if self.n_success == 0:
            raise PredictionError("No models have been fitted")
        if df is None and periods is not None:
            df = self.make_future(periods, freq, include_history)
        if df is None:
            if self.keys:
                raise DataValidationError("Either periods or future_df must be provided")
            if self.history is None:
                raise PredictionError("A loaded model has no training rows")
            df = self.history
        df = io.as_frame(self.params_df.sparkSession, df)
        small = predicting.is_small(self.n_success, self.config)
        return predicting.predict(prepare.coerce(df, self.config, self.keys, training=False), self.params_df, self.config, self.keys, small)

    def regressor_coefficients(self) -> DataFrame:
        if not self.config.regressors:
            raise DataValidationError("No extra regressors found.")
        return regressor_coefficients(self.params_df, self.keys)

    def to_json(self, *key) -> str:
        row = self._row(*key)
        if row is None:
            raise PredictionError("No models have been fitted")
        return store.row_to_text(row)

    def save(self, path: str, format: str = "parquet") -> None:
        store.save(self.params_df, path, format)


def regressor_coefficients(params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """regressor, regressor_mode, center, std, coef (in the units of y, or relative), prior_scale."""
    rows = params.filter(F.col("error").isNull()).select(*keys, "beta", "y_scale", F.explode(F.filter("features", lambda f: f["kind"] == "regressor")).alias("f"))
    beta = F.get("beta", F.col("f.start"))
    coef = F.when(F.col("f.mode") == "additive", beta * F.col("y_scale") / F.col("f.std")).otherwise(beta / F.col("f.std"))
    return rows.select(*keys, F.col("f.name").alias("regressor"), F.col("f.mode").alias("regressor_mode"), F.col("f.mu").alias("center"), F.col("f.std").alias("std"), coef.alias("coef"), F.col("f.prior_scale").alias("prior_scale"))


def _from_params(params: DataFrame, keys: Sequence[str]) -> FittedForecaster:
    row = params.filter(F.col("config").isNotNull()).select("config").first()
    if row is None:
        raise PredictionError("No models have been fitted")
    return FittedForecaster(Config.from_json(row["config"]), params, None, keys)


def load(spark: SparkSession, path: str, keys: Sequence[str] = (), format: str = "parquet", key_fields: Sequence[T.StructField] = ()) -> FittedForecaster:
    """A stored model; without ``keys``, its key columns are those that the params table has besides its own."""
    params = store.load(spark, path, format, key_fields)
    found = [name for name in params.columns if name not in PARAMS.names]
    if keys and set(keys) != set(found):
        raise DataValidationError(f"the stored model is keyed by {found}, not by {list(keys)}")
    return _from_params(params, keys or found)


def from_json(spark: SparkSession, text: str, key_fields: Sequence[T.StructField] = ()) -> FittedForecaster:
    texts = spark.range(1).select(F.lit(text).alias("model"))
    return _from_params(store.from_json(texts, key_fields).cache(), [f.name for f in key_fields])

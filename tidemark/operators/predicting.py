"""Prediction: a join of rows with the params of their series and one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config, z_score
from tidemark.errors import DataValidationError
from tidemark.functions import expressions as X
from tidemark.schema import FORECAST_COLUMNS, PARAMS

#: Params rows, and estimated bytes of them, up to which they are broadcast.
MOST_BROADCAST, BROADCAST_BYTES = 20_000, 128 << 20


def is_small(rows: int, config: Config) -> bool:
    """Whether so many params rows may be broadcast: each holds numbers for all features, holiday dates and changepoints."""
    numbers = 40 + 4 * config.n_changepoints + sum(2 * x.fourier_order for x in config.all_seasonalities()) + sum(3 * x.width * max(1, len(x.dates)) for x in config.holidays) + 4 * len(config.regressors)
    return rows <= MOST_BROADCAST and 8 * rows * numbers <= BROADCAST_BYTES


def _block(kind: str, name: str) -> Column:
    found = F.filter("features", lambda f: (f["kind"] == kind) & (f["name"] == name))
    return F.get(found, F.lit(0))


def prepared(params: DataFrame, config: Config, keys: Sequence[str]) -> DataFrame:
    """What prediction needs of each params row: trend arrays, and each block's coefficients in an array of its own."""
    fitted = params.filter(F.col("error").isNull())
    rates, offsets = X.trend_arrays(config.growth, F.col("k"), F.col("m"), F.col("delta"), F.col("t_change"), F.col("gamma"))
    out = [
        *keys, "t0", "t_scale", "y_scale", "t_change", "sigma_obs", "logistic_floor", "last_cap", "last_floor", "interval_width",
        F.col("m").alias("_m"), rates.alias("_rates") if config.growth != "flat" else F.lit(None).cast("array<double>").alias("_rates"), offsets.alias("_offsets") if config.growth != "flat" else F.lit(None).cast("array<double>").alias("_offsets"),
    ]
    for kind, parts in (("seasonality", config.all_seasonalities()), ("holiday", config.holidays), ("regressor", config.regressors)):
        for part in parts:
            block = _block(kind, part.name)
            out.append(F.when(block.isNotNull(), F.slice("beta", block["start"] + 1, block["end"] - block["start"])).alias(f"_{kind}_{part.name}"))
            if kind == "regressor":
                out += [block["mu"].alias(f"_mu_{part.name}"), block["std"].alias(f"_std_{part.name}")]
    return fitted.select(*out)


def margin(width: Column, sigma: Column, y_scale: Column) -> Column:
    z = F.lit(z_score(0.8))
    for fixed in (0.8, 0.9, 0.95, 0.99):
        z = F.when(F.round(width * 100) == round(fixed * 100), z_score(fixed)).otherwise(z)
    return z * sigma * y_scale


def forecast(joined: DataFrame, config: Config, keys: Sequence[str], z: float | None = None) -> DataFrame:
    """The forecast columns of rows that hold ds, the optional columns and what :func:`prepared` gives."""
    have = set(joined.columns)
    t = X.scaled_time(F.col("ds"), F.col("t0"), F.col("t_scale"))
    days = X.days_since(F.col("ds"), F.col("t0"))
    zero = F.lit(0.0)
    low = F.when(F.col("logistic_floor"), F.coalesce(*([F.col("floor")] if "floor" in have else []), F.col("last_floor"), zero)).otherwise(zero)
    cap = F.coalesce(*([F.col("cap")] if "cap" in have else []), F.col("last_cap"), F.lit(1e9))
    rows = joined.withColumns({"_t": t, "_days": days, "_low": low})
    rows = rows.withColumn("_n", X.active(F.col("_t"), F.col("t_change")))
    arrays = F.col("_rates"), F.col("_offsets"), F.col("_n")
    if config.growth == "linear":
        trend = X.piecewise_linear(F.col("_t"), *arrays)
    elif config.growth == "logistic":
        trend = X.piecewise_logistic(F.col("_t"), (cap - F.col("_low")) / F.col("y_scale"), *arrays)
    else:
        trend = F.col("_m")

    parts: list[tuple[str, str, Column]] = []
    for x in config.all_seasonalities():
        value = F.coalesce(X.dot(X.fourier_terms(F.col("_days"), x.period, x.fourier_order), F.col(f"`_seasonality_{x.name}`")), zero)
        if x.condition_name:
            value = F.when(F.col(f"`{x.condition_name}`"), value).otherwise(zero)
        parts.append((x.name, x.mode, value))
    for x in config.holidays:
        parts.append((f"holiday {x.name}", x.mode, F.coalesce(X.dot(X.holiday_terms(F.col("ds"), x.dates, x.lower_window, x.upper_window, config.pool_holidays), F.col(f"`_holiday_{x.name}`")), zero)))
    for x in config.regressors:
        scaled = (F.col(f"`{x.name}`") - F.col(f"`_mu_{x.name}`")) / F.col(f"`_std_{x.name}`")
        parts.append((f"regressor {x.name}", x.mode, scaled * F.get(F.col(f"`_regressor_{x.name}`"), F.lit(0))))
    total = lambda mode: sum((v for _, m, v in parts if m == mode), zero)
    rows = rows.withColumns({"_trend": trend, "_add": total("additive"), "_mult": total("multiplicative"), "_margin": margin(F.col("interval_width"), F.col("sigma_obs"), F.col("y_scale")) if z is None else F.lit(z) * F.col("sigma_obs") * F.col("y_scale")})
    scale = F.col("y_scale")

    def component(name: str) -> Column:
        return sum((v * scale if m == "additive" else v for n, m, v in parts if n == name), zero)

    centre = {
        "trend": F.col("_trend") * scale + F.col("_low"),
        "yhat": (F.col("_trend") * (F.lit(1.0) + F.col("_mult")) + F.col("_add")) * scale + F.col("_low"),
        "additive_terms": F.col("_add") * scale,
        "multiplicative_terms": F.col("_mult"),
        "weekly": component("weekly"),
        "yearly": component("yearly"),
    }
    rows = rows.withColumns({f"_c_{name}": value for name, value in centre.items()})
    out = {"ds": F.col("ds")}
    for name in centre:
        out |= {name: F.col(f"_c_{name}"), f"{name}_lower": F.col(f"_c_{name}") - F.col("_margin"), f"{name}_upper": F.col(f"_c_{name}") + F.col("_margin")}
    return rows.select(*keys, *(out[name].alias(name) for name in FORECAST_COLUMNS))


def predict(rows: DataFrame, params: DataFrame, config: Config, keys: Sequence[str] = (), small: bool | None = None) -> DataFrame:
    """Forecasts of ``rows`` (coerced); series without params give no rows.

    ``small``: whether the params are known to be at most MOST_BROADCAST rows and BROADCAST_BYTES; None asks the table.
    """
    keys = list(keys)
    if missing := [c for c in params.columns if c not in PARAMS.names and c not in keys]:
        raise DataValidationError(f"the params are of series keyed by {missing}; give these as keys")
    ready = prepared(params, config, keys)
    if not keys:
        return forecast(rows.crossJoin(F.broadcast(ready)), config, keys, _z(config))  # one row of params
    if small is None:
        small = is_small(params.limit(MOST_BROADCAST + 1).count(), config)
    return forecast(rows.join(F.broadcast(ready) if small else ready, keys), config, keys, _z(config))


def _z(config: Config) -> float | None:
    """Other widths than the four of the table take the normal quantile of the configuration."""
    return None if round(config.interval_width * 100) in (80, 90, 95, 99) else z_score(config.interval_width)

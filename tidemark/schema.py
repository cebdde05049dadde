"""Schemas of forecasts and of the params table (one row for each series)."""

from __future__ import annotations

from pyspark.sql import types as T

FORECAST_COLUMNS = (
    "ds", "trend", "yhat_lower", "yhat_upper", "trend_lower", "trend_upper", "additive_terms", "additive_terms_lower", "additive_terms_upper",
    "weekly", "weekly_lower", "weekly_upper", "yearly", "yearly_lower", "yearly_upper", "multiplicative_terms", "multiplicative_terms_lower", "multiplicative_terms_upper", "yhat",
)

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "ntz": T.TimestampNTZType(),
    "doubles": T.ArrayType(T.DoubleType()),
    "strings": T.ArrayType(T.StringType()),
}


def _struct(**kinds: str | T.DataType) -> T.StructType:
    """Without a session, so that workers can import it."""
    return T.StructType([T.StructField(name, _TYPES[kind] if isinstance(kind, str) else kind) for name, kind in kinds.items()])


FEATURE = _struct(
    kind="string", name="string", mode="string", period="double", fourier_order="int", prior_scale="double", condition="string", mu="double", std="double",
    lower_window="int", upper_window="int", dates="strings", start="int", end="int",
)
PARAMS = _struct(
    growth="string", n_changepoints="int", changepoint_range="double", changepoint_prior_scale="double", seasonality_mode="string", interval_width="double",
    t0="ntz", t_last="ntz", t_scale="double", y_scale="double", logistic_floor="boolean", last_cap="double", last_floor="double",
    t_change="doubles", k="double", m="double", delta="doubles", gamma="doubles", beta="doubles", sigma_obs="double",
    features=T.ArrayType(FEATURE), n_obs="long", converged="boolean", n_iter="int", objective="double", error="string", config="string", version="string",
)

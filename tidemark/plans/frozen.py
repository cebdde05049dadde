"""Models with given parameters: a params table for Spark and the same model as SQL, to check prediction without a fit."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark import __version__
from tidemark.config import Config, z_score
from tidemark.schema import FEATURE, FORECAST_COLUMNS, PARAMS

SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
T0, T_SCALE, Y_SCALE, SIGMA = dt.datetime(1995, 1, 1), 172_800_000.0, 1_000_000.0, 0.05
T_CHANGE, DELTA = [0.2, 0.5, 0.8], [0.3, -0.5, 0.2]
LAST_CAP, LAST_FLOOR = 3_000_000.0, 100_000.0


def blocks(config: Config) -> list[dict]:
    """Feature blocks in the order of the coefficients, with fixed mu and std for regressors."""
    empty = dict.fromkeys(FEATURE.names)
    found = [(empty | {"kind": "seasonality", "name": x.name, "mode": x.mode, "period": float(x.period), "fourier_order": x.fourier_order, "prior_scale": 10.0, "condition": x.condition_name}, 2 * x.fourier_order) for x in config.all_seasonalities()]
    found += [(empty | {"kind": "holiday", "name": x.name, "mode": x.mode, "prior_scale": 10.0, "lower_window": x.lower_window, "upper_window": x.upper_window, "dates": list(x.dates)}, len(x.dates) * x.width) for x in config.holidays]
    found += [(empty | {"kind": "regressor", "name": x.name, "mode": x.mode, "prior_scale": x.prior_scale, "mu": 4.0, "std": 2.0}, 1) for x in config.regressors]
    found.sort(key=lambda b: b[0]["mode"] != "additive")
    at = 0
    for block, width in found:
        block["start"], block["end"] = at, at + width
        at += width
    return [block for block, _ in found]


def beta(n: int) -> list[float]:
    return [0.01 * (j + 1) * (-1) ** j / (1 + j // 4) for j in range(n)]


def rate(at: int) -> float:
    return 0.5 + 0.1 * at


def offset(at: int) -> float:
    return 0.2 + 0.05 * at


def gamma(config: Config, at: int) -> list[float]:
    k, m, out = rate(at), offset(at), []
    for s, d in zip(T_CHANGE, DELTA, strict=True):
        g = (s - m) * (1 - k / (k + d))
        out, k, m = [*out, g], k + d, m + g
    return out if config.growth == "logistic" else []


def params(spark: SparkSession, config: Config, key: str = "series") -> DataFrame:
    own = blocks(config)
    rows = []
    for at, name in enumerate(SERIES):
        row = {
            key: name, "growth": config.growth, "n_changepoints": 3, "changepoint_range": 0.8, "changepoint_prior_scale": 0.05, "seasonality_mode": config.seasonality_mode, "interval_width": config.interval_width,
            "t0": T0, "t_last": T0 + dt.timedelta(seconds=T_SCALE), "t_scale": T_SCALE, "y_scale": Y_SCALE, "logistic_floor": config.growth == "logistic", "last_cap": LAST_CAP, "last_floor": LAST_FLOOR,
            "t_change": T_CHANGE, "k": rate(at), "m": offset(at), "delta": DELTA, "gamma": gamma(config, at), "beta": beta(own[-1]["end"] if own else 0), "sigma_obs": SIGMA,
            "features": own, "n_obs": 1000, "converged": True, "n_iter": 0, "objective": 0.0, "error": None, "config": config.to_json(), "version": __version__,
        }
        rows.append(row)
    schema = T.StructType([T.StructField(key, T.StringType()), *PARAMS.fields])
    return spark.createDataFrame([tuple(row[name] for name in schema.names) for row in rows], schema)


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def sql_predict(config: Config, source: str, extra: str = "", cap: str = "", floor: str = "") -> str:
    """SQL for the forecast of the relation ``source`` (series, ds and what the model needs), rounded as :func:`rounded`."""
    own = blocks(config)
    coefficients = beta(own[-1]["end"] if own else 0)
    steps = list(zip(T_CHANGE, DELTA, strict=True))
    k = "(k" + "".join(f" + CASE WHEN t >= {_d(s)} THEN {_d(d)} ELSE 0 END" for s, d in steps) + ")"
    low = f"coalesce({floor + ', ' if floor else ''}{_d(LAST_FLOOR)})" if config.growth == "logistic" else "0::DOUBLE"
    if config.growth == "linear":
        trend = k + " * t + (m" + "".join(f" + CASE WHEN t >= {_d(s)} THEN {_d(-s * d)} ELSE 0 END" for s, d in steps) + ")"
    elif config.growth == "logistic":
        shift = "(m" + "".join(f" + CASE WHEN t >= {_d(s)} THEN g{i} ELSE 0 END" for i, (s, _) in enumerate(steps)) + ")"
        top = f"((coalesce({cap + ', ' if cap else ''}{_d(LAST_CAP)}) - {low}) / {_d(Y_SCALE)})"
        trend = f"{top} / (1 + exp(-{k} * (t - {shift})))"
    else:
        trend = "m"
    parts: dict[str, tuple[str, str]] = {}
    for block in own:
        b = coefficients[block["start"] : block["end"]]
        if block["kind"] == "seasonality":
            terms = [f"{f}({_d(2 * math.pi * i)} * days / {_d(block['period'])}) * {_d(b[2 * i - 2 + o])}" for i in range(1, block["fourier_order"] + 1) for o, f in enumerate(("sin", "cos"))]
            value = "(" + " + ".join(terms) + ")"
            if block["condition"]:
                value = f"CASE WHEN {block['condition']} THEN {value} ELSE 0 END"
        elif block["kind"] == "holiday":
            offsets = [(date, o) for date in block["dates"] for o in range(block["lower_window"], block["upper_window"] + 1)]
            value = "(" + " + ".join(f"CASE WHEN date_diff('day', DATE '{date}', ds::DATE) = {o} THEN {_d(c)} ELSE 0 END" for (date, o), c in zip(offsets, b, strict=True)) + ")"
        else:
            value = f"(({block['name']} - 4.0::DOUBLE) / 2.0::DOUBLE * {_d(b[0])})"
        parts[f"{block['kind']} {block['name']}"] = (block["mode"], value)
    add = " + ".join(v for m, v in parts.values() if m == "additive") or "0::DOUBLE"
    mult = " + ".join(v for m, v in parts.values() if m != "additive") or "0::DOUBLE"

    def component(name: str) -> str:
        mode, value = parts.get(f"seasonality {name}", ("additive", "0::DOUBLE"))
        return f"({value}) * {_d(Y_SCALE)}" if mode == "additive" else f"({value})"

    values = ", ".join(f"('{name}', {_d(rate(i))}, {_d(offset(i))}" + "".join(f", {_d(g)}" for g in gamma(config, i)) + ")" for i, name in enumerate(SERIES))
    names = "series, k, m" + "".join(f", g{i}" for i in range(len(gamma(config, 0))))
    centre = {"trend": f"tr * {_d(Y_SCALE)} + low", "yhat": f"(tr * (1 + mult) + add_) * {_d(Y_SCALE)} + low", "additive_terms": f"add_ * {_d(Y_SCALE)}", "multiplicative_terms": "mult", "weekly": "weekly_", "yearly": "yearly_"}
    margin = _d(z_score(config.interval_width) * SIGMA * Y_SCALE)
    out = []
    for name in FORECAST_COLUMNS[1:]:
        base = name.removesuffix("_lower").removesuffix("_upper")
        sign = " - " if name.endswith("_lower") else " + " if name.endswith("_upper") else None
        out.append(f"round({centre[base]}{sign + margin if sign else ''}, 4) + 0.0 AS {name}")
    return f"""
, p({names}) AS (VALUES {values}),
j AS (SELECT s.*, p.* EXCLUDE (series), date_diff('microsecond', TIMESTAMP '{T0}', ds) / 1e6::DOUBLE / {_d(T_SCALE)} AS t, date_diff('second', TIMESTAMP '{T0}', ds) / 86400.0::DOUBLE AS days FROM {source} s JOIN p USING (series)),
c AS (SELECT series, ds{extra}, {trend} AS tr, {add} AS add_, {mult} AS mult, {component("weekly")} AS weekly_, {component("yearly")} AS yearly_, {low} AS low FROM j)
SELECT series, ds, {", ".join(out)} FROM c"""

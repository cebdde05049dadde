"""One enormous series: its normal equations are summed by the cluster, and only a small matrix comes to the driver.

Exact for linear or flat trends with additive features.  The group function of :mod:`fitting` reads the whole
series in one worker; here the tasks share it, and none holds more than a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import __version__
from tidemark.config import Config, adaptive_settings
from tidemark.operators import fitting, prepare, solver
from tidemark.schema import PARAMS
from tidemark.sources.shipping import ship


def normal_equations(df: DataFrame, terms: list[str], y: str = "y", weight: str | None = None) -> DataFrame:
    """(i, j, value) of X'WX (i <= j) and X'Wy (j = number of terms), as partial sums of the columns ``terms``."""
    w = F.col(weight) if weight else F.lit(1.0)
    columns = [*(F.col(c) for c in terms), F.col(y)]
    cells = [(i, j) for i in range(len(terms)) for j in range(i, len(columns))]
    sums = df.agg(*(F.sum(w * columns[i] * columns[j]).alias(f"s_{i}_{j}") for i, j in cells))
    stacked = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("value")) for i, j in cells))
    return sums.select(F.inline(stacked))


def order_statistics(rows: DataFrame, places: list[int]) -> list[int]:
    """The ds (in microseconds) at each of ``places`` of the rows by ds, from counts by ever finer units of time.

    Rows are only counted, nothing is sorted; of each unit, only those parts that hold a place come to the driver.
    """
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ds"))
    before, inside = {None: 0}, {None: list(places)}  # of each unit that holds places: rows before it, the places
    last = None
    for unit in (fitting.DAY, 60_000_000, 1_000_000, 1_000, 1):
        own = rows.select(F.floor(at / F.lit(unit)).alias("unit") if unit > 1 else at.alias("unit"))
        if last is not None:
            own = own.filter(F.floor(F.col("unit") / F.lit(last // unit)).isin(list(inside)))
        counts = own.groupBy("unit").agg(F.count("*").alias("n")).orderBy("unit").toPandas()
        parent = (counts["unit"] // (last // unit)).to_numpy() if last is not None else np.zeros(len(counts))
        found_before, found_inside = {}, {}
        for key, held in inside.items():
            group = counts[parent == key] if key is not None else counts
            upto = before[key] + group["n"].cumsum().to_numpy()
            for place in held:
                row = int(np.searchsorted(upto, place, side="right"))
                name = int(group["unit"].iloc[row])
                found_before[name] = int(upto[row - 1]) if row else before[key]
                found_inside.setdefault(name, []).append(place)
        before, inside, last = found_before, found_inside, unit
    by_place = {place: name for name, held in inside.items() for place in held}
    return [by_place[place] for place in places]


def changepoint_times(rows: DataFrame, n: int, count: int, share: float, t0: int, span: float) -> np.ndarray:
    """Scaled times at the places of automatic changepoints."""
    wanted = fitting.places(n, count, share)
    return np.unique([(v - t0) / 1e6 / span for v in order_statistics(rows, wanted)]) if wanted else np.zeros(0)


def fit_large(df: DataFrame, config: Config) -> dict:
    """The params of a single series of any length (a dict as of :func:`fitting.fit_series`)."""
    if not fitting.is_exact(config):
        raise ValueError("only linear or flat trends with additive features have fixed normal equations")
    ship(df.sparkSession)
    rows = prepare.drop_null_y(prepare.coerce(df, config))
    facts = prepare.scales(rows, []).first()
    if facts is None or facts["n_obs"] < 2:
        raise ValueError("Dataframe has less than 2 non-NaN rows")
    if "weight" in rows.columns and (bad := prepare.series_checks(rows, []).first()) is not None and bad["negative_weight"]:
        raise ValueError("weights must be non-negative")
    t0, span, y_scale, n = int(fitting.micros(pd.Series([facts["t0"]]))[0]), facts["t_scale"], facts["y_scale"], facts["n_obs"]
    count, tau = adaptive_settings(n, config.n_changepoints, config.changepoint_prior_scale) if config.changepoints is None else (0, config.changepoint_prior_scale)
    if config.changepoints is not None:
        times = [(v - t0) / 1e6 / span for v in map(fitting._parsed, config.changepoints) if v is not None]
        s = np.unique([v for v in times if 0 <= v <= 1])
    else:
        s = changepoint_times(rows, n, count, config.changepoint_range, t0, span) if config.growth == "linear" else np.zeros(0)
    stats = {x.name: prepare.regressor_stats(rows, [], x.name, x.standardize).first() for x in config.regressors}
    fixed = {name: (row["mu"], row["std"]) for name, row in stats.items()}

    def block(pdf: pd.DataFrame) -> tuple[np.ndarray, list[dict]]:
        plain = pdf.copy()
        for name, (mu, std) in fixed.items():
            plain[name] = (plain[name] - mu) / std
        raw = Config.from_json(config.to_json())
        raw = raw.__class__(**{**raw.__dict__, "regressors": tuple(x.__class__(x.name, x.prior_scale, "false", x.mode) for x in raw.regressors)})
        return fitting.design(plain, fitting.micros(pdf["ds"]), t0, raw, facts["span_days"])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            t = (fitting.micros(pdf["ds"]) - t0) / 1e6 / span
            floor = pdf["floor"].fillna(0.0).to_numpy(float) if "floor" in pdf else 0.0
            y = (pdf["y"].to_numpy(float) - floor) / y_scale
            w = pdf["weight"].fillna(1.0).to_numpy(float) if "weight" in pdf else np.ones(len(t))
            first = np.zeros_like(t) if config.growth == "flat" else t
            all_ = np.column_stack([first, np.ones_like(t), solver.hinge(t, s), block(pdf)[0], y])
            part = np.append((all_ * w[:, None]).T @ all_, w.sum())
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    _, features = block(rows.limit(1).toPandas())
    found = rows.mapInPandas(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toPandas()["value"].to_numpy()
    weight, moments = found[-1], found[:-1].reshape(int(np.sqrt(len(found) - 1)), -1)
    prior = np.concatenate([np.full(f["end"] - f["start"], f["prior_scale"]) for f in features] or [np.zeros(0)])
    precision = np.concatenate([[1 / 25.0, 1 / 25.0], np.zeros(len(s)), 1.0 / np.maximum(prior, 0.01) ** 2])
    theta, sigma, value, steps, done = solver.solve_gram(moments[:-1, :-1], moments[:-1, -1], moments[-1, -1], weight, precision, np.arange(2, 2 + len(s)), max(tau, 1e-9))
    for f in features:
        if f["kind"] == "regressor":
            f["mu"], f["std"] = fixed[f["name"]]
    last = rows.agg(*(F.max_by(F.coalesce(F.col(c), F.lit(default)), "ds").alias(c) for c, default in (("cap", 1e9), ("floor", 0.0)) if c in rows.columns)).first().asDict() if {"cap", "floor"} & set(rows.columns) else {}
    return {
        "growth": config.growth, "n_changepoints": int(count) if config.changepoints is None else len(s), "changepoint_range": config.changepoint_range, "changepoint_prior_scale": float(tau),
        "seasonality_mode": config.seasonality_mode, "interval_width": config.interval_width, "t0": facts["t0"], "t_last": facts["t_last"], "t_scale": span, "y_scale": y_scale,
        "logistic_floor": "floor" in rows.columns, "last_cap": last.get("cap"), "last_floor": last.get("floor"), "t_change": s.tolist(), "k": float(theta[0]), "m": float(theta[1]),
        "delta": theta[2 : 2 + len(s)].tolist(), "gamma": [], "beta": theta[2 + len(s) :].tolist(), "sigma_obs": float(sigma), "features": features, "n_obs": n,
        "converged": bool(done), "n_iter": int(steps), "objective": float(value), "error": None, "config": config.to_json(), "version": __version__,
    }


def fit_large_params(df: DataFrame, config: Config) -> DataFrame:
    """The params table (one row) of a single series of any length."""
    row = fit_large(df, config)
    return df.sparkSession.createDataFrame([tuple(row[name] for name in PARAMS.names)], PARAMS)

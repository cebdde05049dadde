"""Fits one model for each series: a grouped map whose group function is plain numpy.

A series that cannot be fitted gives a params row with its error; it never fails the job.  Where the model's moments are
sums, a worker holds no more than a batch of a long series: its rows wait in a file until what a fit takes from all of them
is known.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark import __version__
from tidemark.config import Config, adaptive_settings
from tidemark.operators import prepare, solver
from tidemark.schema import FEATURE, PARAMS
from tidemark.sources.shipping import ship

DAY = 86_400_000_000  # microseconds
#: Rows of a series up to which it is fitted in memory, rows of a batch in the file of a longer one, and units of time that a
#: pass over that file counts.
HELD, BATCH, UNITS = 100_000, 10_000, 1 << 16


def micros(ds: pd.Series) -> np.ndarray:
    return ds.to_numpy("datetime64[us]").astype(np.int64)


def places(n: int, count: int, share: float) -> list[int]:
    """Row numbers of automatic changepoints."""
    end = int(np.floor((n - 1) * share))
    if n <= 2 or count == 0 or end <= 1:
        return []
    return [int(min(max(np.floor(i * end / (count + 1) + 0.5), 1), end - 1)) for i in range(1, count + 1)]


def is_exact(config: Config) -> bool:
    """Whether the normal equations of the model are fixed: linear or flat trend, additive features."""
    return config.growth != "logistic" and "multiplicative" not in {x.mode for x in (*config.all_seasonalities(), *config.holidays, *config.regressors)}


def fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2.0 * np.pi * np.arange(1, order + 1)[None, :] * days[:, None] / period
    return np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(days), 2 * order)


def holiday_columns(ds: np.ndarray, dates: Sequence[str], lower: int, upper: int, pooled: bool = False) -> np.ndarray:
    day = ds // DAY
    starts = [np.datetime64(date, "D").astype(np.int64) for date in dates]
    if pooled and starts:
        return np.column_stack([np.isin(day - offset, starts).astype(float) for offset in range(lower, upper + 1)])
    return np.column_stack([(day - start == offset).astype(float) for start in starts for offset in range(lower, upper + 1)] or [np.zeros((len(ds), 0))])


def standardisation(x: np.ndarray, rule: str) -> tuple[float, float]:
    binary = set(np.unique(x)) == {0.0, 1.0}
    if rule == "false" or (rule == "auto" and binary) or x.min() == x.max():
        return 0.0, 1.0
    return float(x.mean()), max(float(x.std()), 1.0)


def design(pdf: pd.DataFrame, ds: np.ndarray, t0: int, config: Config, span_days: int, scaled: dict[str, tuple[float, float]] | None = None) -> tuple[np.ndarray, list[dict]]:
    """The feature matrix and its blocks: additive ones first; seasonalities, holidays, regressors.

    ``scaled``: mu and std of each regressor, where ``pdf`` is but a part of the series.
    """
    days = np.trunc((ds - t0) / 1e6) / 86400.0
    blocks: list[tuple[dict, np.ndarray]] = []
    empty = {name: None for name in FEATURE.names}
    for x in config.all_seasonalities():
        if x.name == "yearly" and span_days < 730:
            continue
        cols = fourier(days, x.period, x.fourier_order)
        if x.condition_name:
            cols = cols * pdf[x.condition_name].fillna(False).to_numpy(bool)[:, None]
        blocks.append((empty | {"kind": "seasonality", "name": x.name, "mode": x.mode, "period": float(x.period), "fourier_order": x.fourier_order, "prior_scale": float(x.prior_scale), "condition": x.condition_name}, cols))
    for x in config.holidays:
        cols = holiday_columns(ds, x.dates, x.lower_window, x.upper_window, config.pool_holidays)
        blocks.append((empty | {"kind": "holiday", "name": x.name, "mode": x.mode, "prior_scale": float(x.prior_scale), "lower_window": x.lower_window, "upper_window": x.upper_window, "dates": list(x.dates)}, cols))
    for x in config.regressors:
        raw = pdf[x.name].to_numpy(float)
        if not np.isfinite(raw).all():
            raise ValueError(f"Regressor '{x.name}' has missing or infinite values")
        mu, std = standardisation(raw, x.standardize) if scaled is None else scaled[x.name]
        blocks.append((empty | {"kind": "regressor", "name": x.name, "mode": x.mode, "prior_scale": float(x.prior_scale), "mu": mu, "std": std}, ((raw - mu) / std)[:, None]))
    blocks.sort(key=lambda b: b[0]["mode"] != "additive")  # stable
    at = 0
    for feature, cols in blocks:
        feature["start"], feature["end"] = at, at + cols.shape[1]
        at += cols.shape[1]
    matrix = np.hstack([cols for _, cols in blocks]) if blocks else np.zeros((len(ds), 0))
    return matrix, [feature for feature, _ in blocks]


def _parsed(text: str) -> int | None:
    try:
        value = np.datetime64(pd.Timestamp(str(text)), "us")
    except ValueError:
        return None
    return int(value.astype(np.int64))


def _require(finite: bool, finite_weights: bool, weights: bool) -> None:
    if not finite:
        raise ValueError("y has infinite values")
    if not finite_weights:
        raise ValueError("weights must be finite")
    if not weights:
        raise ValueError("weights must be non-negative")


def changepoints(config: Config, n: int, t0: int, span: float, at: Callable[[list[int]], Sequence[int]]) -> tuple[int, float, np.ndarray]:
    """Number of changepoints, their prior scale, their scaled times; ``at``: the ds at places of the rows by ds."""
    if config.changepoints is not None:
        given = [(v - t0) / 1e6 / span for v in map(_parsed, config.changepoints) if v is not None]
        s = np.unique([v for v in given if 0.0 <= v <= 1.0])
        return len(s), config.changepoint_prior_scale, s
    count, tau = adaptive_settings(n, config.n_changepoints, config.changepoint_prior_scale)
    wanted = places(n, count, config.changepoint_range) if config.growth != "flat" else []
    return count, tau, np.unique((np.asarray(at(wanted)) - t0) / 1e6 / span) if wanted else np.zeros(0)


def prior_scales(features: list[dict]) -> np.ndarray:
    return np.concatenate([np.full(f["end"] - f["start"], f["prior_scale"]) for f in features] or [np.zeros(0)])


def _row(config: Config, count: int, tau: float, t0: int, t_last: int, span: float, y_scale: float, last: dict[str, float], s: np.ndarray, found: solver.Estimate, features: list[dict], n: int) -> dict:
    gamma = solver.gammas(found.k, found.m, found.delta, s) if config.growth == "logistic" else np.zeros(0)
    return {
        "growth": config.growth, "n_changepoints": int(count), "changepoint_range": config.changepoint_range, "changepoint_prior_scale": float(tau),
        "seasonality_mode": config.seasonality_mode, "interval_width": config.interval_width,
        "t0": pd.Timestamp(t0, unit="us"), "t_last": pd.Timestamp(t_last, unit="us"), "t_scale": span, "y_scale": y_scale,
        "logistic_floor": "floor" in last, "last_cap": last.get("cap"), "last_floor": last.get("floor"),
        "t_change": s.tolist(), "k": found.k, "m": found.m, "delta": found.delta.tolist(), "gamma": gamma.tolist(), "beta": found.beta.tolist(), "sigma_obs": found.sigma,
        "features": features, "n_obs": n, "converged": bool(found.converged), "n_iter": int(found.n_iter), "objective": found.objective, "error": None,
    }


def fit_series(pdf: pd.DataFrame, config: Config) -> dict:
    """The params of one series, from rows with ds and y (no null y)."""
    pdf = pdf.dropna(subset=["ds"]).sort_values("ds", kind="stable")
    if len(pdf) < 2:
        raise ValueError("Dataframe has less than 2 non-NaN rows")
    ds, y = micros(pdf["ds"]), pdf["y"].to_numpy(float)
    weight = pdf["weight"].fillna(1.0).to_numpy(float) if "weight" in pdf else np.ones(len(y))
    _require(np.isfinite(y).all(), np.isfinite(weight).all(), (weight >= 0).all())
    floor = pdf["floor"].fillna(0.0).to_numpy(float) if "floor" in pdf else np.zeros(len(y))
    cap = pdf["cap"].fillna(1e9).to_numpy(float) if "cap" in pdf else np.full(len(y), 1e9)
    if config.growth == "logistic" and (cap <= floor).any():
        raise ValueError(f"cap must be greater than floor (first at row {int(np.argmax(cap <= floor))})")
    t0, span = int(ds[0]), max((int(ds[-1]) - int(ds[0])) / 1e6, 1e-12)
    t = (ds - t0) / 1e6 / span
    y_scale = max(float(np.abs(y - floor).max()), 1.0)
    ys, caps = (y - floor) / y_scale, (cap - floor) / y_scale
    count, tau, s = changepoints(config, len(y), t0, span, lambda wanted: ds[wanted])
    matrix, features = design(pdf, ds, t0, config, int((int(ds[-1]) - t0) // DAY))
    prior = prior_scales(features)
    multiplicative = np.concatenate([np.full(f["end"] - f["start"], f["mode"] != "additive") for f in features] or [np.zeros(0)]).astype(bool)
    found = solver.estimate(config.growth, t, ys, caps, weight, matrix, multiplicative, prior, s, tau)
    last = {name: float(values[-1]) for name, values in (("cap", cap), ("floor", floor)) if name in pdf}
    return _row(config, count, tau, t0, int(ds[-1]), span, y_scale, last, s, found, features, len(y))


class Spool:
    """Rows of one series in a file, and what is known of all of them once they are there."""

    def __init__(self, file: BinaryIO, config: Config):
        self.file, self.config = file, config
        self.n, self.t0, self.t_last, self.y_scale = 0, 0, 0, 1.0
        self.last: dict[str, float] = {}  # cap and floor of the last row by ds
        self.valid = (True, True, True)  # as of _require
        self.ranges: dict[str, tuple] = {}  # of each regressor: least, largest, sum, whether 0 or 1, whether finite

    def write(self, batches: Iterator[pd.DataFrame]) -> None:
        """Keep all rows that have ds and y; they may come in any order."""
        writer = None
        conditions = {x.condition_name for x in self.config.seasonalities if x.condition_name}
        kinds = {"ds": pa.timestamp("us")} | {c: pa.bool_() for c in conditions} | {x.name: pa.float64() for x in self.config.regressors}
        for pdf in batches:
            if writer is None:
                schema = pa.schema([(c, kinds.get(c, pa.float64())) for c in pdf.columns])
                writer = pa.ipc.new_stream(self.file, schema)
            pdf = pdf.dropna(subset=["ds", "y"])
            if len(pdf):
                self._note(pdf)
                writer.write_table(pa.Table.from_pandas(pdf, schema=schema, preserve_index=False), BATCH)
        if writer is not None:
            writer.close()

    def _note(self, pdf: pd.DataFrame) -> None:
        ds, y = micros(pdf["ds"]), pdf["y"].to_numpy(float)
        latest = len(ds) - 1 - int(np.argmax(ds[::-1]))
        if not self.n or ds[latest] >= self.t_last:
            self.t_last = int(ds[latest])
            missing = {"cap": 1e9, "floor": 0.0}
            self.last = {name: missing[name] if pd.isna(v := pdf[name].iloc[latest]) else float(v) for name in missing if name in pdf}
        self.t0 = min(self.t0, int(ds.min())) if self.n else int(ds.min())
        self.y_scale = max(self.y_scale, float(np.abs(y - _filled(pdf, "floor", 0.0)).max()))
        weight = _filled(pdf, "weight", 1.0)
        self.valid = tuple(a and bool(b.all()) for a, b in zip(self.valid, (np.isfinite(y), np.isfinite(weight), weight >= 0), strict=True))
        for name in (x.name for x in self.config.regressors):
            x = pdf[name].to_numpy(float)
            low, high, total, binary, finite = self.ranges.get(name, (np.inf, -np.inf, 0.0, True, True))
            self.ranges[name] = (min(low, x.min()), max(high, x.max()), total + x.sum(), binary and np.isin(x, (0.0, 1.0)).all(), finite and np.isfinite(x).all())
        self.n += len(ds)

    def batches(self) -> Iterator[pd.DataFrame]:
        self.file.seek(0)
        with pa.ipc.open_stream(self.file) as reader:
            for batch in reader:
                yield batch.to_pandas()

    def at(self, wanted: list[int]) -> list[int]:
        """The ds at places of the rows by ds, from counts by ever finer units of time; nothing is sorted."""
        low, rank, width = [self.t0] * len(wanted), list(wanted), self.t_last - self.t0 + 1
        while width > 1:
            unit = -(-width // UNITS)
            counts = {start: np.zeros(UNITS, np.int64) for start in low}
            for pdf in self.batches():
                ds = micros(pdf["ds"])
                for start, count in counts.items():
                    count += np.bincount((ds[(ds >= start) & (ds < start + width)] - start) // unit, minlength=UNITS)
            for i, start in enumerate(low):
                upto = counts[start].cumsum()
                row = int(np.searchsorted(upto, rank[i], side="right"))
                low[i], rank[i] = start + row * unit, rank[i] - (int(upto[row - 1]) if row else 0)
            width = unit
        return low

    def standardisations(self) -> dict[str, tuple[float, float]]:
        """mu and std of each regressor, by the rule of :func:`standardisation`."""
        found: dict[str, tuple[float, float]] = {}
        for x in self.config.regressors:
            low, high, total, binary, finite = self.ranges[x.name]
            if not finite:
                raise ValueError(f"Regressor '{x.name}' has missing or infinite values")
            plain = x.standardize == "false" or (x.standardize == "auto" and binary) or low == high
            found[x.name] = (0.0, 1.0) if plain else (float(total / self.n), 0.0)
        open_ = {name: mu for name, (mu, std) in found.items() if not std}
        squares = dict.fromkeys(open_, 0.0)
        for pdf in self.batches() if open_ else ():
            for name, mu in open_.items():
                squares[name] += float(((pdf[name].to_numpy(float) - mu) ** 2).sum())
        return found | {name: (mu, max(float(np.sqrt(squares[name] / self.n)), 1.0)) for name, mu in open_.items()}


def _filled(pdf: pd.DataFrame, name: str, value: float) -> np.ndarray:
    return pdf[name].fillna(value).to_numpy(float) if name in pdf else np.full(len(pdf), value)


def fit_long(batches: Iterator[pd.DataFrame], config: Config) -> dict:
    """As :func:`fit_series`, for an exact model and a series of any length: only sums and a batch are in memory."""
    with tempfile.TemporaryFile() as file:
        rows = Spool(file, config)
        rows.write(batches)
        if rows.n < 2:
            raise ValueError("Dataframe has less than 2 non-NaN rows")
        _require(*rows.valid)
        t0, span, n_days = rows.t0, max((rows.t_last - rows.t0) / 1e6, 1e-12), (rows.t_last - rows.t0) // DAY
        count, tau, s = changepoints(config, rows.n, t0, span, rows.at)
        scaled = rows.standardisations()
        moments, weight, features = 0.0, 0.0, []
        for pdf in rows.batches():
            ds, w = micros(pdf["ds"]), _filled(pdf, "weight", 1.0)
            matrix, features = design(pdf, ds, t0, config, n_days, scaled)
            y = (pdf["y"].to_numpy(float) - _filled(pdf, "floor", 0.0)) / rows.y_scale
            all_ = np.column_stack([solver.columns(config.growth, (ds - t0) / 1e6 / span, s, matrix), y])
            moments, weight = moments + all_.T @ (all_ * w[:, None]), weight + float(w.sum())
    found = solver.from_moments(moments[:-1, :-1], moments[:-1, -1], float(moments[-1, -1]), weight, prior_scales(features), len(s), tau)
    return _row(config, count, tau, t0, rows.t_last, span, rows.y_scale, rows.last, s, found, features, rows.n)


def fit_batches(batches: Iterator[pd.DataFrame], config: Config) -> dict:
    """The params of one series, from its rows in batches; other than exact models are fitted in memory at any length."""
    held, n, exact = [], 0, is_exact(config)
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if exact and n > HELD:
            return fit_long(chain(held, batches), config)
    return fit_series(pd.concat(held, ignore_index=True).dropna(subset=["y"]), config)


def params_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*(df.schema[key] for key in keys), *PARAMS.fields])


def fit(df: DataFrame, config: Config, keys: Sequence[str] = ()) -> DataFrame:
    """The params table: one row for each series, errors included.  One exchange by key; only needed columns are shuffled."""
    ship(df.sparkSession)
    keys = list(keys)
    rows = prepare.coerce(df, config, keys)
    # A series that has only null y still gets its row: the filter on y is part of the group function.
    schema = params_schema(rows, keys)
    text = config.to_json()

    own = [c for c in rows.columns if c not in keys]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, ended = dict.fromkeys(schema.names) | {"config": text, "version": __version__, "n_obs": 0}, False
        if (first := next((pdf for pdf in batches if len(pdf)), None)) is None:
            return

        def seen() -> Iterator[pd.DataFrame]:
            nonlocal ended
            for pdf in chain([first], batches):
                row["n_obs"] += int(pdf["y"].notna().sum())
                yield pdf[own]
            ended = True

        row |= {key: first[key].iloc[0] for key in keys}
        rest = seen()
        try:
            found = fit_batches(rest, Config.from_json(text))
        except OSError:  # the file's, such as a full disk
            raise
        except Exception as error:  # any other failure belongs to the series
            for _ in rest:
                pass
            if not ended:  # its rows could not be read
                raise
            found = {"error": str(error) or type(error).__name__}
        row |= found
        out = pd.DataFrame([row], columns=schema.names, dtype=object)
        for field in schema.fields:
            if isinstance(field.dataType, T.TimestampNTZType) and field.name not in keys:
                out[field.name] = pd.to_datetime(out[field.name])
        yield out

    if keys:
        return rows.groupBy(*keys).applyInPandas(one, schema)
    return rows.repartition(1).mapInPandas(one, schema)  # no group, so nothing is sorted by its key

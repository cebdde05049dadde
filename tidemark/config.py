"""Model configuration: immutable, checked when made."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

GROWTHS = ("linear", "logistic", "flat")
MODES = ("additive", "multiplicative")
RESERVED = ("yearly", "weekly", "daily")


def _mode(value: str) -> str:
    if str(value).lower() not in MODES:
        raise ValueError(f"Invalid mode '{value}': must be 'additive' or 'multiplicative'")
    return str(value).lower()


def _day(value) -> str:
    """A holiday's date as text; None where it is none (such dates are skipped)."""
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    try:
        return dt.date.fromisoformat(str(value)[:10]).isoformat()
    except ValueError:
        return ""


@dataclass(frozen=True)
class Seasonality:
    name: str
    period: float
    fourier_order: int
    prior_scale: float = 10.0
    mode: str = "additive"
    condition_name: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "mode", _mode(self.mode))
        if self.fourier_order <= 0:
            raise ValueError("Fourier order must be > 0")
        if not self.period > 0:
            raise ValueError("Period must be > 0")


@dataclass(frozen=True)
class Holiday:
    name: str
    dates: tuple[str, ...]
    lower_window: int = 0
    upper_window: int = 0
    prior_scale: float = 10.0
    mode: str = "additive"

    def __post_init__(self):
        object.__setattr__(self, "mode", _mode(self.mode))
        object.__setattr__(self, "dates", tuple(day for day in map(_day, self.dates) if day))
        if self.upper_window < self.lower_window:
            raise ValueError("upper_window must not be below lower_window")

    @property
    def width(self) -> int:
        return self.upper_window - self.lower_window + 1


@dataclass(frozen=True)
class Regressor:
    name: str
    prior_scale: float = 10.0
    standardize: str = "auto"
    mode: str = "additive"

    def __post_init__(self):
        object.__setattr__(self, "mode", _mode(self.mode))
        object.__setattr__(self, "standardize", str(self.standardize).lower())
        if self.standardize not in ("auto", "true", "false"):
            raise ValueError("standardize must be 'auto', 'true' or 'false'")
        if not self.prior_scale > 0:
            raise ValueError("Prior scale must be > 0")


@dataclass(frozen=True)
class Config:
    growth: str = "linear"
    n_changepoints: int = 15
    changepoint_range: float = 0.8
    changepoint_prior_scale: float = 0.05
    yearly_seasonality: bool = True
    weekly_seasonality: bool = True
    daily_seasonality: bool = False
    seasonality_mode: str = "additive"
    interval_width: float = 0.8
    changepoints: tuple[str, ...] | None = None
    seasonalities: tuple[Seasonality, ...] = field(default=())
    holidays: tuple[Holiday, ...] = field(default=())
    regressors: tuple[Regressor, ...] = field(default=())
    countries: tuple[str, ...] = field(default=())
    #: Whether all occurrences of a holiday share one effect for each day of its window, so that later ones get it too.
    pool_holidays: bool = False

    def __post_init__(self):
        if str(self.growth).lower() not in GROWTHS:
            raise ValueError(f"Invalid growth '{self.growth}': must be 'linear', 'logistic' or 'flat'")
        object.__setattr__(self, "growth", str(self.growth).lower())
        object.__setattr__(self, "seasonality_mode", _mode(self.seasonality_mode))
        if not (0.0 <= self.changepoint_range <= 1.0):
            raise ValueError("changepoint_range must be in [0, 1]")
        if self.n_changepoints < 0:
            raise ValueError("n_changepoints must not be negative")
        if not 0 < self.interval_width < 1:
            raise ValueError("interval_width must be in (0, 1)")
        if self.changepoints is not None:
            object.__setattr__(self, "changepoints", tuple(x.isoformat(sep=" ") if isinstance(x, dt.datetime) else str(x) for x in self.changepoints))

    def with_seasonality(self, seasonality: Seasonality) -> Config:
        if seasonality.name in RESERVED or any(x.name == seasonality.name for x in self.seasonalities):
            raise ValueError(f"Seasonality '{seasonality.name}' already exists or is reserved")
        return replace(self, seasonalities=(*self.seasonalities, seasonality))

    def with_holiday(self, holiday: Holiday) -> Config:
        if any(x.name == holiday.name for x in self.holidays):
            raise ValueError(f"Holiday '{holiday.name}' already exists")
        return replace(self, holidays=(*self.holidays, holiday))

    def with_regressor(self, regressor: Regressor) -> Config:
        if any(x.name == regressor.name for x in self.regressors):
            raise ValueError(f"Regressor '{regressor.name}' already exists")
        return replace(self, regressors=(*self.regressors, regressor))

    def all_seasonalities(self) -> tuple[Seasonality, ...]:
        """Built-in ones first; yearly is left out of a series that spans under 730 days."""
        # Period, order and prior scale of the built-in seasonalities.
        built_in = (
            (self.yearly_seasonality, Seasonality("yearly", 365.25, 10, 10.0, self.seasonality_mode)),
            (self.weekly_seasonality, Seasonality("weekly", 7.0, 3, 10.0, self.seasonality_mode)),
            (self.daily_seasonality, Seasonality("daily", 1.0, 4, 10.0, self.seasonality_mode)),
        )
        return (*(x for used, x in built_in if used), *self.seasonalities)

    def needed_columns(self) -> tuple[str, ...]:
        """Regressor and condition columns that a frame must have."""
        return tuple(dict.fromkeys([*(x.name for x in self.regressors), *(x.condition_name for x in self.seasonalities if x.condition_name)]))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Tolerant: fields that are missing get their defaults, unknown ones are ignored."""
        raw = json.loads(text)
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        parts = {"seasonalities": Seasonality, "holidays": Holiday, "regressors": Regressor}
        for name, kind in parts.items():
            known[name] = tuple(kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items() if k in kind.__dataclass_fields__}) for x in known.get(name) or ())
        for name in ("changepoints", "countries"):
            if isinstance(known.get(name), list):
                known[name] = tuple(known[name])
        return cls(**known)


def z_score(width: float) -> float:
    """Half-width of an interval in standard deviations: four fixed values, else the normal quantile."""
    fixed = {80: 1.28, 90: 1.645, 95: 1.96, 99: 2.576}  # fixed values
    key = round(width * 100)
    if key in fixed and abs(width * 100 - key) < 1e-9:
        return fixed[key]
    low, high = 0.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < width else (low, mid)
    return (low + high) / 2


#: Rows from which a tier holds, its most changepoints and largest prior scale.
TIERS = ((75_000, 10, 0.02), (25_000, 15, 0.03), (10_000, 20, 0.04))


def adaptive_settings(n_obs: int, n_changepoints: int, prior_scale: float) -> tuple[int, float]:
    """Fewer and stiffer changepoints for long series."""
    for rows, most, scale in TIERS:
        if n_obs >= rows:
            return min(n_changepoints, most), min(prior_scale, scale)
    return n_changepoints, prior_scale


def as_dates(values: Sequence) -> tuple[str, ...]:
    return tuple(day for day in map(_day, values) if day)

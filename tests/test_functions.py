"""Exact facts of single operators, in expressions and in numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Config, Holiday, Regressor, Seasonality, adaptive_settings, z_score
from tidemark.functions import expressions as X
from tidemark.operators import calendar, fitting, solver


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(("text", "expected"), [("2020-01-15", dt.datetime(2020, 1, 15)), ("2020-01-15 12:30:45", dt.datetime(2020, 1, 15, 12, 30, 45)), ("invalid", None), ("2020/01/15", None), ("2020", None), ("2020-02-30", None)])
def test_parse_ds(spark, text, expected):
    assert value(spark, X.parse_ds(F.lit(text))) == expected


@pytest.mark.parametrize(("last", "freq", "periods", "expected"), [
    ("2020-01-31 22:00:00", "H", 3, ["2020-01-31 23:00", "2020-02-01 00:00", "2020-02-01 01:00"]),
    ("2020-01-31 05:00:00", "D", 3, ["2020-02-01", "2020-02-02", "2020-02-03"]),
    ("2020-01-31", "w", 2, ["2020-02-07", "2020-02-14"]),
    ("2020-01-15", "M", 2, ["2020-02-14", "2020-03-15"]),
    ("2020-01-15", "Y", 2, ["2021-01-14", "2022-01-14"]),
    ("2020-01-31", "MS", 2, ["2020-02-01", "2020-02-02"]),
    ("2020-01-31", "D", 0, []),
])
def test_future_dates(spark, last, freq, periods, expected):
    assert value(spark, calendar.future_dates(ts(last), periods, freq)) == [pd.Timestamp(x).to_pydatetime() for x in expected]


def test_trends(spark):
    s, d = F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.1), F.lit(-0.05))
    gamma = value(spark, X.logistic_gamma(F.lit(0.5), F.lit(0.5), d, s))
    assert gamma == pytest.approx([-0.033333, -0.021212], abs=1e-6)
    assert solver.gammas(0.5, 0.5, np.array([0.1, -0.05]), np.array([0.3, 0.7])) == pytest.approx(gamma)
    for growth in ("linear", "logistic"):
        rates, offsets = X.trend_arrays(growth, F.lit(0.5), F.lit(0.5), d, s, X.logistic_gamma(F.lit(0.5), F.lit(0.5), d, s))
        for t in (0.0, 0.3, 0.5, 0.9, 1.4):
            n = X.active(F.lit(t), s)
            own = X.piecewise_linear(F.lit(t), rates, offsets, n) if growth == "linear" else X.piecewise_logistic(F.lit(t), F.lit(2.0), rates, offsets, n)
            twin = solver.trend(growth, np.array([t]), np.array([2.0]), 0.5, 0.5, np.array([0.1, -0.05]), np.array([0.3, 0.7]))[0]
            assert value(spark, own) == pytest.approx(twin)


def test_features_agree(spark):
    days = [0.0, 1.5, 7.0, 400.25]
    twin = fitting.fourier(np.array(days), 7.0, 3)
    assert twin[0] == pytest.approx([0, 1] * 3) and twin[2] == pytest.approx([0, 1] * 3, abs=1e-12)
    for at, day in enumerate(days):
        assert value(spark, F.array(*X.fourier_terms(F.lit(day), 7.0, 3))) == pytest.approx(list(twin[at]))
    ds = pd.to_datetime(["2020-01-14 00:00", "2020-01-15 13:00", "2020-01-16 00:00", "2020-01-17 00:00"]).to_numpy("datetime64[us]").astype(np.int64)
    twin = fitting.holiday_columns(ds, ("2020-01-15",), -1, 1)
    assert twin.tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0]]
    assert value(spark, F.array(*X.holiday_terms(ts("2020-01-15 13:00:00"), ("2020-01-15",), -1, 1))) == [0, 1, 0]


def test_starts():
    k, m = solver.linear_start(np.array([0, 0.5, 1.0]), np.array([0.5307511, 0.6, 0.8362182]))
    assert (k, m) == (pytest.approx(0.3054671), pytest.approx(0.5307511))
    k, m = solver.logistic_start(np.array([0, 0.5, 1.0]), np.array([0.3, 0.5, 0.7]), np.ones(3))
    assert k > 0 and abs(m) < 10


def test_changepoint_places():
    found = fitting.places(100, 5, 0.8)
    assert len(found) == 5 and max(found) < 80 and fitting.places(2, 5, 0.8) == [] and fitting.places(100, 0, 0.8) == []


@pytest.mark.parametrize(("n", "count", "tau", "expected"), [(5000, 25, 0.05, (25, 0.05)), (30000, 25, 0.05, (15, 0.03)), (120000, 25, 0.05, (10, 0.02)), (120000, 0, 0.01, (0, 0.01))])
def test_adaptive(n, count, tau, expected):
    assert adaptive_settings(n, count, tau) == expected


def test_config_checks():
    for bad in ({"growth": "cubic"}, {"changepoint_range": 1.5}, {"changepoint_range": float("nan")}, {"seasonality_mode": "both"}, {"interval_width": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        Seasonality("x", 7, 0)
    with pytest.raises(ValueError):
        Holiday("x", ("2020-01-01",), 2, 1)
    with pytest.raises(ValueError, match="already exists"):
        Config().with_regressor(Regressor("a")).with_regressor(Regressor("a"))
    with pytest.raises(ValueError, match="reserved"):
        Config().with_seasonality(Seasonality("weekly", 7, 3))
    full = Config(changepoints=("2020-01-01",)).with_regressor(Regressor("a")).with_holiday(Holiday("h", ("2020-01-01", "bad"))).with_seasonality(Seasonality("m", 30.5, 5, condition_name="c"))
    assert Config.from_json(full.to_json()) == full and full.holidays[0].dates == ("2020-01-01",)
    assert Config.from_json('{"growth": "flat", "unknown": 1}') == Config(growth="flat")


def test_z_score():
    assert [z_score(w) for w in (0.8, 0.9, 0.95, 0.99)] == [1.28, 1.645, 1.96, 2.576]
    assert z_score(0.5) == pytest.approx(0.6744898, abs=1e-6)

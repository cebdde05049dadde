"""Fits of frames in memory, of long series, and what prediction asks of the params."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.errors import DataValidationError
from tidemark.model import Forecaster, load
from tidemark.operators import gram, predicting, starts


def series(n, freq="D", start="2015-01-01"):
    i = np.arange(n)
    return pd.DataFrame({"ds": pd.date_range(start, periods=n, freq=freq), "y": 100 + 0.1 * i + 10 * np.sin(2 * np.pi * i / 7) + np.random.default_rng(1).normal(0, 1, n)})


class Polars:
    def __init__(self, pdf):
        self.to_pandas = lambda: pdf


def test_frames_in_memory(spark):
    want = Forecaster().fit(spark.createDataFrame(series(60))).model()
    for frame in (series(60), Polars(series(60))):
        fitted = Forecaster().fit(frame)
        assert fitted.model()["k"] == pytest.approx(want["k"]) and fitted.predict(series(3)).count() == 3
    with pytest.raises(TypeError):
        Forecaster().fit([1, 2])


def test_long_series_are_fitted_from_sums(spark, monkeypatch):
    df = spark.createDataFrame(series(10_000, "h")).withColumn("floor", F.lit(1.0)).repartition(4)
    want = Forecaster(daily_seasonality=True).fit(df)
    monkeypatch.setattr(model, "LARGE_BYTES", 0)
    monkeypatch.setattr(model, "LARGE_ROWS", 5000)
    monkeypatch.setattr(model.fitting, "fit", None)
    found = Forecaster(daily_seasonality=True).fit(df)
    one, two = want.model(), found.model()
    assert one.keys() == two.keys()
    for name in ("growth", "n_changepoints", "t0", "t_last", "n_obs", "logistic_floor", "last_floor", "config", "converged"):
        assert one[name] == two[name], name
    for name in ("k", "m", "sigma_obs", "objective", "y_scale"):
        assert one[name] == pytest.approx(two[name], rel=1e-4, abs=1e-6), name
    assert one["t_change"] == pytest.approx(two["t_change"]) and one["beta"] == pytest.approx(two["beta"], abs=1e-5)
    a, b = (x.predict(periods=5, freq="H").orderBy("ds").toPandas() for x in (want, found))
    assert np.allclose(a.yhat, b.yhat, rtol=1e-5)
    with pytest.raises(DataValidationError, match="non-negative"):
        Forecaster().fit(df.withColumn("weight", F.lit(-1.0)))


def test_order_statistics_need_no_sort(spark):
    rng = np.random.default_rng(0)
    us = np.concatenate([rng.integers(0, 3 * 86_400_000_000, 4000), np.full(500, 86_400_000_001), rng.integers(-5_000_000, 5_000_000, 500)])
    df = spark.createDataFrame(pd.DataFrame({"ds": us.astype("datetime64[us]")}))
    places = [0, 1, 77, 2500, 2501, 4999, *rng.integers(0, 5000, 12).tolist()]
    assert gram.order_statistics(df, places) == np.sort(us)[places].tolist()


def test_ten_thousand_rows(spark):
    pdf = pd.DataFrame({"ds": pd.date_range("2000-01-01", periods=10_000), "y": 100 + np.random.default_rng(42).normal(0, 1, 10_000).cumsum()})
    fitted = Forecaster(yearly_seasonality=False, weekly_seasonality=False).fit(pdf)
    out = fitted.predict(periods=100, include_history=True).toPandas()
    assert len(out) == 10_100 and out.yhat.notna().all() and fitted.model()["n_changepoints"] == 15


def test_prediction_runs_no_job_of_its_own(spark):
    fitted = Forecaster().fit(series(60))
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("predict", "predict")
    fitted.predict(periods=30)
    assert not status.getJobIdsForGroup("predict")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stored_models_know_their_keys(spark, tmp_path):
    many = spark.createDataFrame(pd.concat([series(40).assign(shop=s) for s in "abc"]))
    fitted = Forecaster().fit(many, ["shop"])
    fitted.save(str(tmp_path / "m"))
    back = load(spark, str(tmp_path / "m"))
    assert back.keys == ["shop"] and back.predict(many.select("shop", "ds").limit(5)).count() == 5
    with pytest.raises(DataValidationError, match="shop"):
        load(spark, str(tmp_path / "m"), ["item"])
    with pytest.raises(DataValidationError, match="shop"):
        predicting.predict(many.select("ds"), fitted.params_df, fitted.config)
    fitted.unpersist()


def test_pooled_holidays_reach_later_years(spark):
    pdf = series(1460, start="2017-01-01")
    christmas = (pdf.ds.dt.month == 12) & (pdf.ds.dt.day == 25)
    pdf.loc[christmas, "y"] += 300
    dates = [f"{year}-12-25" for year in range(2017, 2023)]
    future = pd.DataFrame({"ds": pd.to_datetime(["2022-12-24", "2022-12-25"])})
    lift = {}
    for pooled in (False, True):
        fitted = Forecaster(pool_holidays=pooled).add_holidays("christmas", dates).fit(pdf)
        out = fitted.predict(future).orderBy("ds").toPandas().yhat
        lift[pooled] = out[1] - out[0]
        assert len(fitted.model()["beta"]) == 26 + (1 if pooled else 6)
    assert lift[True] > 200 > 50 > lift[False]


def test_starts():
    t = np.linspace(0, 1, 200)
    y = np.where(t < 0.5, t, 0.5 - (t - 0.5))
    assert starts.delta(t, y, np.array([0.5]), 2.0) == pytest.approx([-1.1], abs=0.2) and starts.sigma(np.zeros(5)) == 0.01
    x = np.random.default_rng(0).normal(size=(200, 2))
    assert starts.beta(x, x @ [0.5, -9.0], np.full(2, 1e-6)) == pytest.approx([0.5, -2.0], abs=1e-3)
    assert starts.worth_it(200, 10, 5) and not starts.worth_it(199, 10, 5) and not starts.worth_it(99, 0, 0)


@pytest.mark.parametrize("growth", ["linear", "logistic"])
def test_a_start_never_costs_accuracy(spark, monkeypatch, growth):
    pdf = series(400).assign(cap=300.0)
    config = {"growth": growth, "seasonality_mode": "multiplicative", "yearly_seasonality": False, "n_changepoints": 5}
    hot = Forecaster(**config).fit(pdf).model()
    from tidemark.config import Config
    from tidemark.operators import fitting

    monkeypatch.setattr(starts, "worth_it", lambda *_: False)
    cold = fitting.fit_series(pdf, Config(**config))
    assert hot["objective"] <= cold["objective"] + 0.5

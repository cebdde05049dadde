"""Fits: parameter recovery, invariances, errors, persistence."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import model as api
from tidemark.config import Config
from tidemark.errors import DataValidationError
from tidemark.model import Forecaster
from tidemark.operators import gram, metrics, solver
from tidemark.schema import FORECAST_COLUMNS

N = 800
I = np.arange(N)
DS = pd.date_range("2018-01-01", periods=N)
CLEAN = 10 + 0.5 * I + 5 * np.sin(2 * np.pi * I / 365.25) + 2 * np.sin(2 * np.pi * I / 7)


def noise(scale=1.0, n=N, seed=0):
    return np.random.default_rng(seed).normal(0, scale, n)


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame({"ds": DS[: len(next(iter(columns.values())))], **columns}))


def fitted_values(fitted, df=None):
    return fitted.predict(df).toPandas().sort_values("ds")


def test_linear_recovery_and_schema(spark):
    out = fitted_values(Forecaster().fit(frame(spark, y=CLEAN + noise(2))))
    assert tuple(out.columns) == FORECAST_COLUMNS
    assert np.sqrt(np.mean((out.yhat - CLEAN) ** 2)) < 0.7
    assert np.allclose(out.yhat_upper - out.yhat, out.yhat - out.yhat_lower) and (out.yhat_upper > out.yhat).all()


@pytest.mark.parametrize("y", [10 + 0.5 * I[:100], np.full(50, 10.0), np.array([10.0, 11, 12, 11, 10]), np.full(100, 0.001), np.array([1.0, 2.0])])
def test_easy_series(spark, y):
    assert fitted_values(Forecaster().fit(frame(spark, y=y))).yhat.to_numpy() == pytest.approx(y, abs=0.5)


def test_y_scale(spark):
    assert Forecaster().fit(frame(spark, y=10 + 0.5 * I[:100])).model()["y_scale"] == 59.5
    assert Forecaster().fit(frame(spark, y=np.full(100, 0.001))).model()["y_scale"] == 1.0
    low = Forecaster(growth="logistic").fit(frame(spark, y=20 + 0.5 * I[:100], floor=np.full(100, 10.0), cap=np.full(100, 100.0)))
    assert low.model()["y_scale"] == 59.5
    out = fitted_values(low)
    assert out.trend.between(10, 100).all()


def test_logistic_multiplicative_flat(spark):
    y = 100 / (1 + np.exp(-(I[:300] - 150) / 30))
    out = fitted_values(Forecaster(growth="logistic", yearly_seasonality=False).fit(frame(spark, y=y + noise(2, 300), cap=np.full(300, 110.0))))
    assert np.sqrt(np.mean((out.yhat - y) ** 2)) < 2
    y = (50 + 0.2 * I) * (1 + 0.2 * np.sin(2 * np.pi * I / 7))
    out = fitted_values(Forecaster(seasonality_mode="multiplicative").fit(frame(spark, y=y + noise(2))))
    assert np.sqrt(np.mean((out.yhat - y) ** 2)) < 1 and out.multiplicative_terms.abs().max() < 0.5 and (out.additive_terms == 0).all()
    y = 20 + 3 * np.sin(2 * np.pi * I / 7)
    out = fitted_values(Forecaster(growth="flat").fit(frame(spark, y=y + noise())))
    assert out.trend.nunique() == 1 and np.sqrt(np.mean((out.yhat - y) ** 2)) < 0.7


def test_regressors_holidays_conditions(spark):
    x, b = noise(5, seed=1), (I % 7 > 4).astype(float)
    peak = np.asarray(DS.strftime("%m-%d") == "12-25")
    data = pd.DataFrame({"ds": DS, "y": 100 + 0.1 * I + 3 * x - 10 * b + 300 * peak + noise(), "x": x, "b": b})
    fitted = Forecaster(weekly_seasonality=False).add_regressor("x").add_regressor("b").add_holidays("h", ["2018-12-25", "2019-12-25"], -1, 1).fit(spark.createDataFrame(data))
    coef = fitted.regressor_coefficients().toPandas().set_index("regressor").coef
    assert coef["x"] == pytest.approx(3, abs=0.1) and coef["b"] == pytest.approx(-10, abs=0.5)
    out = fitted_values(fitted)
    assert out.yhat.to_numpy()[peak].min() > out.yhat.to_numpy()[~peak].max()
    with pytest.raises(DataValidationError, match="Regressor 'x' not found"):
        fitted.predict(spark.createDataFrame(data[["ds"]]))
    weekday = DS.dayofweek < 5
    shaped = pd.DataFrame({"ds": DS, "y": 10 + np.where(weekday, 2 * np.sin(2 * np.pi * I / 7), 0), "is_weekday": weekday})
    own = Forecaster(weekly_seasonality=False, yearly_seasonality=False).add_seasonality("w", 7, 3, condition_name="is_weekday").fit(spark.createDataFrame(shaped))
    assert np.abs(fitted_values(own).additive_terms.to_numpy()[~weekday]).max() == 0
    with pytest.raises(DataValidationError, match="must be boolean"):
        Forecaster().add_seasonality("w", 7, 3, condition_name="is_weekday").fit(spark.createDataFrame(shaped.assign(is_weekday=1)))


def test_weights(spark):
    clean = 1000 + 0.5 * I[:500] + 100 * np.sin(2 * np.pi * I[:500] / 365.25)
    y, w = clean + noise(10, 500), np.ones(500)
    for at in range(50, 401, 50):
        y[at] += 200 if at % 100 else -200
        w[at] = 0.1
    maker = lambda: Forecaster(weekly_seasonality=False).add_seasonality("y", 365.25, 3)
    plain, weighted = (fitted_values(maker().fit(df)).yhat.to_numpy() for df in (frame(spark, y=y), frame(spark, y=y, weight=w)))
    assert np.abs(weighted - clean).mean() < np.abs(plain - clean).mean()
    with pytest.raises(DataValidationError, match="non-negative"):
        Forecaster().fit(frame(spark, y=I[:50] * 1.0, weight=np.full(50, -1.0)))
    twice = pd.concat([pd.DataFrame({"ds": DS[:60], "y": CLEAN[:60]})] * 2)
    options = {"changepoints": [], "yearly_seasonality": False}
    a = Forecaster(**options).fit(spark.createDataFrame(twice)).model()
    b = Forecaster(**options).fit(frame(spark, y=CLEAN[:60], weight=np.full(60, 2.0))).model()
    assert a["k"] == pytest.approx(b["k"], rel=1e-5) and a["sigma_obs"] == pytest.approx(b["sigma_obs"], rel=1e-4)


def test_invariances(spark):
    df = frame(spark, y=CLEAN + noise(2))
    one = Forecaster().fit(df).model()
    other = Forecaster().fit(df.orderBy(F.rand(3)).repartition(7)).model()
    scaled = Forecaster().fit(df.withColumn("y", F.col("y") * 1000)).model()
    for found in (other, scaled):
        assert found["beta"] == pytest.approx(one["beta"], abs=1e-6) and found["k"] == pytest.approx(one["k"], abs=1e-6)


def test_objective_is_minimal():
    t = np.linspace(0, 1, 300)
    y = 0.3 + 0.5 * t + 0.4 * np.maximum(t - 0.5, 0) + noise(0.02, 300)
    s, x = np.linspace(0.1, 0.8, 8), np.column_stack([np.sin(40 * t), np.cos(40 * t)])
    found = solver.estimate("linear", t, y, None, np.ones(300), x, np.zeros(2, bool), np.full(2, 10.0), s, 0.05)
    precision, laplace = np.concatenate([[0.04, 0.04], np.zeros(8), [0.01, 0.01]]), np.arange(2, 10)

    def total(theta, sigma):
        r = y - np.column_stack([t, np.ones(300), solver.hinge(t, s), x]) @ theta
        return solver.objective(theta, precision, laplace, 0.05, float(r @ r), 300.0, sigma)

    theta = np.concatenate([[found.k, found.m], found.delta, found.beta])
    best, rng = total(theta, found.sigma), np.random.default_rng(0)
    assert best == pytest.approx(found.objective)
    for scale in (1e-4, 1e-3, 1e-2):
        for _ in range(200):
            assert total(theta + rng.normal(0, scale, len(theta)), found.sigma * np.exp(rng.normal(0, scale))) > best - 1e-6


def test_many_series_and_failures(spark):
    good = [pd.DataFrame({"series": name, "ds": DS[:91], "y": start + I[:91] * 1.0}) for name, start in (("A", 0), ("B", 100))]
    bad = pd.DataFrame({"series": "bad", "ds": DS[:1], "y": [1.0]})
    empty = pd.DataFrame({"series": "empty", "ds": DS[:3], "y": [np.nan] * 3})
    fitted = Forecaster().fit(spark.createDataFrame(pd.concat([*good, bad, empty])), ["series"])
    assert (fitted.n_success, fitted.n_failed) == (2, 2) and "2/4 series" in fitted.summary()
    assert "less than 2 non-NaN rows" in fitted.error("bad") and fitted.model("bad") is None and fitted.error("A") is None
    out = fitted.predict(periods=3).toPandas()
    assert sorted(out.series.unique()) == ["A", "B"] and len(out) == 6 and out.columns[0] == "series"
    assert out[out.series == "B"].yhat.min() > 180
    assert len(fitted.predict(periods=2, include_history=True).toPandas()) == 2 * 93
    with pytest.raises(ValueError, match="Either periods or future_df"):
        fitted.predict()
    with pytest.raises(DataValidationError, match="Column 'nope' not found"):
        Forecaster().fit(spark.createDataFrame(bad), ["nope"])


def test_errors(spark):
    with pytest.raises(ValueError, match="must have 'ds' and 'y' columns"):
        Forecaster().fit(spark.range(3))
    with pytest.raises(ValueError, match="less than 2 non-NaN rows"):
        Forecaster().fit(frame(spark, y=[10.0]))
    with pytest.raises(ValueError, match="less than 2"):
        Forecaster().fit(frame(spark, y=[1.0, 2.0]).limit(0))
    with pytest.raises(ValueError, match="cap must be greater"):
        Forecaster(growth="logistic").fit(frame(spark, y=[1.0, 2.0], cap=[0.0, 5.0]))
    with pytest.raises(ValueError, match="No extra regressors"):
        Forecaster().fit(frame(spark, y=[1.0, 2.0, 3.0])).regressor_coefficients()


def test_nulls_strings_duplicates_times(spark):
    y = (CLEAN[:100]).copy()
    y[10:20] = np.nan
    assert Forecaster().fit(frame(spark, y=y)).model()["n_obs"] == 90
    text = spark.createDataFrame(pd.DataFrame({"ds": DS[:50].strftime("%Y-%m-%d"), "y": CLEAN[:50]}))
    assert len(Forecaster().fit(text).predict().toPandas()) == 50
    both = pd.concat([pd.DataFrame({"ds": DS[:60], "y": CLEAN[:60]}), pd.DataFrame({"ds": DS[:60], "y": CLEAN[:60] + 10})])
    assert Forecaster().fit(spark.createDataFrame(both)).model()["n_obs"] == 120
    hours = pd.DataFrame({"ds": pd.date_range("2020-01-01", periods=240, freq="h"), "y": 50 + 10 * np.sin(2 * np.pi * np.arange(240) / 24)})
    fitted = Forecaster(daily_seasonality=True, weekly_seasonality=False).fit(spark.createDataFrame(hours))
    assert fitted.make_future(3, "H", include_history=False).toPandas().ds.tolist() == list(pd.date_range("2020-01-11", periods=3, freq="h"))
    assert np.abs(fitted_values(fitted).yhat.to_numpy() - hours.y.to_numpy()).max() < 1


def test_manual_changepoints(spark):
    fitted = Forecaster(changepoints=["2018-06-01", "junk", "1990-01-01"], yearly_seasonality=False).fit(frame(spark, y=CLEAN))
    assert fitted.model()["t_change"] == pytest.approx([151 / 799])
    assert Forecaster(changepoints=[]).fit(frame(spark, y=CLEAN)).model()["t_change"] == []


def test_persistence(spark, tmp_path):
    data = frame(spark, y=CLEAN + noise(), x=noise(5, seed=2))
    fitted = Forecaster(changepoints=["2018-06-01"]).add_regressor("x").add_holidays("h", ["2018-12-25"]).fit(data)
    rows = frame(spark, x=np.zeros(5))
    want = fitted_values(fitted, rows).yhat.tolist()
    for format in ("parquet", "json"):
        fitted.save(str(tmp_path / format), format)
        assert fitted_values(api.load(spark, str(tmp_path / format), format=format), rows).yhat.tolist() == pytest.approx(want, rel=1e-12)
    again = api.from_json(spark, fitted.to_json())
    assert fitted_values(again, rows).yhat.tolist() == pytest.approx(want, rel=1e-12) and again.config == fitted.config


def test_large_series_and_backtest(spark):
    df = frame(spark, y=CLEAN + noise(2), x=noise(5, seed=3))
    maker = Forecaster().add_regressor("x")
    a, b = gram.fit_large(df, maker.config), maker.fit(df).model()
    assert a["objective"] == pytest.approx(b["objective"], abs=1e-4) and a["beta"] == pytest.approx(b["beta"], abs=1e-4) and a["t_change"] == pytest.approx(b["t_change"])
    ahead = metrics.backtest(df, Config(), ["2019-06-01", "2019-12-01"], 30)
    found = metrics.errors(ahead, ["cutoff"]).toPandas()
    assert found.n.tolist() == [30, 30] and found.rmse.max() < 15


def test_streaming(spark, tmp_path):
    from tidemark.streaming.scoring import score_stream

    fitted = Forecaster().fit(frame(spark, y=CLEAN))
    rows = frame(spark, y=CLEAN[:20]).select("ds")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job = score_stream(stream, fitted.params_df, fitted.config).writeStream.format("memory").queryName("scored").start()
    job.processAllAvailable()
    job.stop()
    assert spark.table("scored").count() == 20


def test_country_calendar(spark):
    days = spark.createDataFrame([("XX", "peak", "2018-12-25"), ("XX", "peak", "2019-12-25"), ("YY", "other", "2018-05-01")], "country string, holiday string, ds string")
    assert [x.dates for x in Forecaster().add_country_holidays("XX", days).config.holidays] == [("2018-12-25", "2019-12-25")]

import pandas as pd
import pytest

from tidemark import plotting
from tidemark.model import Forecaster
from tidemark.sources import io


def test_read_fit_write(spark, tmp_path):
    raw = pd.DataFrame({"shop": ["a"] * 40 + ["b"], "day": [*pd.date_range("2020-01-01", periods=40).strftime("%Y-%m-%d"), "2020-01-01"], "sold": range(41), "other": 1})
    spark.createDataFrame(raw).write.option("header", True).csv(str(tmp_path / "in"))
    df = io.read_series(spark, str(tmp_path / "in"), {"series": "shop", "ds": "day", "y": "sold"}, "csv", header=True, inferSchema=False)
    fitted = Forecaster().fit(df, ["series"])
    io.write_forecast(fitted.predict(periods=3), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    io.write_errors(fitted.errors_df, str(tmp_path / "errors"))
    assert "b: " in spark.read.text(str(tmp_path / "errors")).first()[0]


def test_as_frame(spark):
    df = io.as_frame(spark, pd.DataFrame({"ds": pd.date_range("2020-01-01", periods=3), "y": [1.0, 2.0, 3.0]}))
    assert dict(df.dtypes)["ds"] == "timestamp_ntz" and io.as_frame(spark, df) is df
    with pytest.raises(TypeError):
        io.as_frame(spark, [1, 2])


def test_plots_need_matplotlib(spark):
    df = Forecaster().fit(io.as_frame(spark, pd.DataFrame({"ds": pd.date_range("2020-01-01", periods=9), "y": range(9)}))).predict()
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            plotting.plot(df)

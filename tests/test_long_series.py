"""Long series in one worker: the same fit from a file of batches, in memory that does not grow with the rows."""

import io
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Config, Holiday, Regressor, Seasonality
from tidemark.operators import fitting
from tidemark.plans import catalogue

REGRESSORS = Config().with_regressor(Regressor("price")).with_regressor(Regressor("promo")).with_regressor(Regressor("flat")).with_regressor(Regressor("forced", standardize="true"))
CONFIGS = {
    "default": Config(daily_seasonality=True),
    "flat": Config(growth="flat", changepoints=("2016-05-01",)),
    "given": Config(changepoints=("2016-05-01", "2015-03-01 12:00:00", "2031-01-01", "never")),
    "none": Config(n_changepoints=0, yearly_seasonality=False, weekly_seasonality=False),
    "regressors": REGRESSORS,
    "conditions": Config().with_seasonality(Seasonality("busy", 3.5, 2, condition_name="open")).with_holiday(Holiday("h", ("2016-01-01", "2017-01-01"), 0, 1)),
}


def rows(n=20_000, seed=0):
    rng = np.random.default_rng(seed)
    i = rng.permutation(n)
    pdf = pd.DataFrame({"ds": pd.Timestamp("2015-01-01") + pd.to_timedelta(i // 2 * 2, "h"), "y": 50 + 0.001 * i + 5 * np.sin(2 * np.pi * i / 24) + rng.normal(0, 1, n)})
    pdf = pdf.assign(price=rng.normal(20, 5, n), promo=(i % 7 == 0) * 1.0, flat=3.0, forced=(i % 3 == 0) * 1.0, open=np.where(i % 5 == 0, None, i % 2 == 0), weight=1.0 + i % 3, floor=1.0, cap=1e3 + i)
    pdf.loc[::97, "y"] = None
    pdf.loc[5::101, "ds"] = None
    pdf.loc[::89, ["weight", "floor"]] = None
    return pdf


@pytest.mark.parametrize("name", CONFIGS)
@pytest.mark.parametrize("extra", [[], ["weight", "floor", "cap"]])
def test_the_same_fit_from_a_file(name, extra):
    config = CONFIGS[name]
    pdf = rows()[["ds", "y", *extra, *config.needed_columns()]]
    want = fitting.fit_series(pdf.dropna(subset=["y"]), config)
    found = fitting.fit_long((pdf[at : at + 1500] for at in range(0, len(pdf), 1500)), config)
    assert found.keys() == want.keys()
    assert found["objective"] == pytest.approx(want["objective"], rel=1e-9)
    for key, value in want.items():
        if key == "features":
            for one, two in zip(found[key], value, strict=True):
                assert {k: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for k, v in two.items()} == one
        elif isinstance(value, (float, list)):
            assert found[key] == pytest.approx(value, rel=1e-4, abs=1e-6), key  # a constant regressor and m share a level
        elif key != "n_iter":
            assert found[key] == value, key


def test_places_without_a_sort():
    rng = np.random.default_rng(0)
    us = np.concatenate([rng.integers(-(10**15), 10**15, 3000), np.full(500, 12_345), rng.integers(0, 3, 500)])
    rng.shuffle(us)
    spool = fitting.Spool(io.BytesIO(), Config())
    spool.write(pd.DataFrame({"ds": part.astype("datetime64[us]"), "y": 1.0}) for part in np.split(us, 8))
    places = [0, 1, 77, 1500, 1501, 2499, 3999, *rng.integers(0, 4000, 12).tolist()]
    assert spool.at(places) == np.sort(us)[places].tolist() and spool.at([]) == []


def workers():
    """Resident and largest resident MB of this machine's Python workers; the largest is counted from now on."""
    found = {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                status = dict(line.split(":", 1) for line in (p / "status").read_text().splitlines() if ":" in line)
                found[p.name] = [int(status[k].split()[0]) / 1024 for k in ("VmRSS", "VmHWM")]
                (p / "clear_refs").write_text("5")
        except (OSError, KeyError):
            continue
    return found


@pytest.mark.skipif(not Path("/proc/self/clear_refs").exists(), reason="needs /proc")
def test_a_worker_does_not_hold_a_long_series(spark, tmp_path):
    ds = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).cast("timestamp_ntz")
    spark.range(0, 800_000, 1, 4).select(ds.alias("ts"), (F.sin(F.col("id") / 9e3) + F.rand(1)).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    before = workers()
    row = catalogue.QUERIES["fit_large_series"](spark, str(tmp_path)).first()
    assert (row["n_obs"], row["agrees"], row["converged"]) == (800_000, True, True)
    grown = [most - before.get(pid, [0])[0] for pid, (_, most) in workers().items()]
    assert grown and max(grown) < 400


def test_errors_of_long_series(spark):
    n = fitting.HELD + 20_000
    rows = spark.range(n + 50).select(F.when(F.col("id") < n, "long").otherwise("short").alias("shop"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ds"), F.col("id").cast("double").alias("y"))
    config = Config(yearly_seasonality=False)
    good = {row["shop"]: row for row in fitting.fit(rows, config, ["shop"]).collect()}
    assert good["long"]["n_obs"] == n and good["short"]["n_obs"] == 50 and all(row["error"] is None and row["converged"] for row in good.values())
    broken = rows.withColumn("y", F.when(F.col("ds") == F.timestamp_seconds(F.lit(60)).cast("timestamp_ntz"), float("inf")).otherwise(F.col("y")))
    bad = {row["shop"]: row for row in fitting.fit(broken, config, ["shop"]).collect()}
    assert (bad["long"]["error"], bad["long"]["n_obs"], bad["short"]["error"]) == ("y has infinite values", n, None)
    assert not fitting.fit(rows.filter("false").drop("shop"), config).collect()
    lone = fitting.fit(rows.drop("shop").limit(1), config).first()
    assert (lone["error"], lone["n_obs"]) == ("Dataframe has less than 2 non-NaN rows", 1)

"""Registered queries of the forecasting engine and their SQL twins.

Frames: ``daily`` (order value by priority and day), ``hourly`` (event value by type and hour), ``shipped`` (line value by
return flag and day).  Every floating output is rounded on both sides, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Config, Holiday, Regressor, Seasonality
from tidemark.functions import expressions as X
from tidemark.model import Forecaster, _from_params, regressor_coefficients
from tidemark.operators import calendar, fitting, gram, metrics, predicting, prepare
from tidemark.plans import frozen
from tidemark.schema import FORECAST_COLUMNS
from tidemark.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["series"]

DAILY = "daily AS (SELECT o_orderpriority AS series, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ds, round(sum(o_totalprice), 2) AS y, count(*) AS n_orders FROM orders GROUP BY 1, 2)"
HOURLY = "hourly AS (SELECT event_type AS series, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ds, round(sum(value), 4) AS y, count(*) AS n FROM events GROUP BY 1, 2)"
SHIPPED = "shipped AS (SELECT l_returnflag AS series, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ds, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY 1, 2)"
TIMED = """s AS (SELECT series, min(ds) AS t0, max(ds) AS t_last, greatest(date_diff('microsecond', min(ds), max(ds)) / 1e6::DOUBLE, 1e-12::DOUBLE) AS t_scale, greatest(max(abs(y)), 1.0::DOUBLE) AS y_scale, count(*) AS n FROM daily GROUP BY 1),
timed AS (SELECT d.*, s.* EXCLUDE (series), date_diff('microsecond', t0, ds) / 1e6::DOUBLE / t_scale AS t, date_diff('second', t0, ds) / 86400.0::DOUBLE AS days, y / y_scale AS ys FROM daily d JOIN s USING (series))"""


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", F.col("o_orderdate")).cast("timestamp_ntz")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("series"), day.alias("ds")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"), F.count("*").alias("n_orders"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("series"), hour.alias("ds")).agg(F.round(F.sum("value"), 4).alias("y"), F.count("*").alias("n"))


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", F.col("l_shipdate")).cast("timestamp_ntz")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("series"), day.alias("ds")).agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily with t0, t_scale, y_scale, t, days and ys (scaled y)."""
    rows = daily(spark, sf_dir)
    joined = rows.join(prepare.scales(rows, KEY), KEY)
    return joined.withColumns({"t": X.scaled_time(F.col("ds"), F.col("t0"), F.col("t_scale")), "days": X.days_since(F.col("ds"), F.col("t0")), "ys": F.col("y") / F.col("y_scale")})


def rnd(column: Column | str, places: int = 6) -> Column:
    return F.round(column, places) + F.lit(0.0)


# Ingest, coercion, filters, checks


@query("ingest_daily_series", f"WITH {DAILY} SELECT * FROM daily")
def _(spark, sf_dir):
    return daily(spark, sf_dir)


@query("ingest_hourly_series", f"WITH {HOURLY} SELECT * FROM hourly")
def _(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(
    "parse_ds_strings",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE '2020-13-45' END AS text FROM orders)
SELECT o_orderkey, text, CASE WHEN regexp_full_match(text, '\\d{4}-\\d{2}-\\d{2}( \\d{2}:\\d{2}:\\d{2})?') THEN try_cast(text AS TIMESTAMP) END AS ds FROM t""",
)
def _(spark, sf_dir):
    form = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("2020-13-45")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", form.alias("text"))
    return rows.withColumn("ds", X.parse_ds(F.col("text")))


@query("drop_null_y", f"WITH {DAILY} SELECT series, count(*) AS n, round(sum(y), 2) AS total FROM daily WHERE day(ds) <> 1 GROUP BY 1")
def _(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("y", F.when(F.dayofmonth("ds") != 1, F.col("y")))
    return prepare.drop_null_y(rows).groupBy("series").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("total"))


@query("min_rows_check", "SELECT o_custkey AS series, count(*) AS n_obs, CASE WHEN count(*) < 2 THEN 'Dataframe has less than 2 non-NaN rows' END AS error FROM orders GROUP BY 1")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("series"), F.col("o_totalprice").alias("y"))
    return prepare.series_checks(prepare.drop_null_y(rows), KEY).withColumn("error", prepare.min_rows_error(F.col("n_obs")))


@query("weight_nonneg_check", f"WITH {DAILY} SELECT series, count(*) AS n_obs, bool_or(CASE WHEN series LIKE '1%' AND day(ds) = 13 THEN -1 ELSE 1 END < 0) AS negative_weight FROM daily GROUP BY 1")
def _(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("weight", F.when(F.col("series").startswith("1") & (F.dayofmonth("ds") == 13), -1.0).otherwise(1.0))
    return prepare.series_checks(rows, KEY)


@query("cap_floor_check", f"WITH {DAILY} SELECT series, count(*) AS n_obs, min(ds) FILTER (y <= 100000) AS bad_cap_ds FROM daily GROUP BY 1")
def _(spark, sf_dir):
    return prepare.series_checks(daily(spark, sf_dir).withColumn("cap", F.col("y")).withColumn("floor", F.lit(100000.0)), KEY)


@query("distinct_series", "SELECT DISTINCT o_orderpriority AS series FROM orders")
def _(spark, sf_dir):
    return prepare.distinct_series(daily(spark, sf_dir), KEY)


@query("series_summary", f"WITH {DAILY} SELECT series, round(avg(y), 4) AS mean, min(y) AS min, max(y) AS max, count(y) AS n FROM daily GROUP BY 1")
def _(spark, sf_dir):
    return prepare.series_summary(daily(spark, sf_dir), KEY).withColumn("mean", F.round("mean", 4))


@query("train_test_split", f"WITH {DAILY} SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 30 AS is_test FROM daily")
def _(spark, sf_dir):
    return prepare.train_test_split(daily(spark, sf_dir), KEY, 30).select("series", "ds", "y", "is_test")


# Scales and aggregates of a fit


@query("time_scale", f"WITH {DAILY}, {TIMED} SELECT series, ds, round(t, 9) AS t FROM timed")
def _(spark, sf_dir):
    return timed(spark, sf_dir).select("series", "ds", rnd("t", 9).alias("t"))


@query("y_scale", f"WITH {DAILY}, {TIMED} SELECT series, ds, round(ys, 9) AS ys FROM timed")
def _(spark, sf_dir):
    return timed(spark, sf_dir).select("series", "ds", rnd("ys", 9).alias("ys"))


@query("y_scale_floor", f"WITH {DAILY} SELECT series, greatest(max(abs(y / 1e9::DOUBLE)), 1.0::DOUBLE) AS y_scale FROM daily GROUP BY 1")
def _(spark, sf_dir):
    return prepare.scales(daily(spark, sf_dir).withColumn("y", F.col("y") / 1e9), KEY).select("series", "y_scale")


@query("yearly_gate", f"WITH {DAILY}, {HOURLY} SELECT series, date_diff('second', min(ds), max(ds)) // 86400 AS span_days, date_diff('second', min(ds), max(ds)) // 86400 >= 730 AS yearly FROM (SELECT series, ds FROM daily UNION ALL SELECT series, ds FROM hourly) GROUP BY 1")
def _(spark, sf_dir):
    both = daily(spark, sf_dir).select("series", "ds", "y").unionByName(hourly(spark, sf_dir).select("series", "ds", "y"))
    return prepare.scales(both, KEY).select("series", "span_days", "yearly")


@query("y_init_stats", f"WITH {DAILY}, {TIMED} SELECT series, round(avg(ys), 8) AS mean, round(stddev_pop(ys), 8) AS std FROM timed GROUP BY 1")
def _(spark, sf_dir):
    return prepare.y_stats(timed(spark, sf_dir), KEY).select("series", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query("residual_sigma_start", f"WITH {DAILY}, {TIMED} SELECT series, round(least(greatest(stddev_pop(ys - t), 0.01::DOUBLE), 10.0::DOUBLE), 8) AS sigma FROM timed GROUP BY 1")
def _(spark, sf_dir):
    return prepare.sigma_start(timed(spark, sf_dir), KEY, F.col("t")).select("series", F.round("sigma", 8).alias("sigma"))


@query("weights_default", f"WITH {DAILY} SELECT series, sum(coalesce(CASE WHEN day(ds) <= 10 THEN 2.0::DOUBLE END, 1.0::DOUBLE)) AS weight FROM daily GROUP BY 1")
def _(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("weight", F.when(F.dayofmonth("ds") <= 10, 2.0))
    return prepare.total_weight(rows, KEY)


@query(
    "y_cap_scaled",
    f"WITH {DAILY}, f AS (SELECT *, 1000.0::DOUBLE AS floor, CASE WHEN day(ds) <= 15 THEN 2 * y END AS cap FROM daily), s AS (SELECT series, greatest(max(abs(y - floor)), 1.0::DOUBLE) AS y_scale FROM f GROUP BY 1) SELECT series, ds, round((y - floor) / y_scale, 9) AS ys, round((coalesce(cap, 1e9::DOUBLE) - floor) / y_scale, 6) AS caps FROM f JOIN s USING (series)",
)
def _(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumns({"floor": F.lit(1000.0), "cap": F.when(F.dayofmonth("ds") <= 15, 2 * F.col("y"))})
    joined = rows.join(prepare.scales(rows, KEY), KEY)
    return joined.select("series", "ds", rnd((F.col("y") - F.col("floor")) / F.col("y_scale"), 9).alias("ys"), rnd((F.coalesce("cap", F.lit(1e9)) - F.col("floor")) / F.col("y_scale")).alias("caps"))


def _weekend(ds: Column) -> Column:
    return F.when(F.dayofweek(ds.cast("date")).isin(1, 7), 1.0).otherwise(0.0)


@query(
    "regressor_stats",
    f"WITH {DAILY} SELECT series, 'n_orders' AS regressor, round(avg(n_orders), 8) AS mu, round(greatest(stddev_pop(n_orders), 1.0::DOUBLE), 8) AS std FROM daily GROUP BY 1 UNION ALL SELECT series, 'weekend', 0.0::DOUBLE, 1.0::DOUBLE FROM daily GROUP BY 1",
)
def _(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("weekend", _weekend(F.col("ds")))
    found = [prepare.regressor_stats(rows, KEY, name).select("series", F.lit(name).alias("regressor"), rnd("mu", 8).alias("mu"), rnd("std", 8).alias("std")) for name in ("n_orders", "weekend")]
    return found[0].unionByName(found[1])


@query("regressor_standardized", f"WITH {DAILY}, r AS (SELECT series, avg(n_orders) AS mu, greatest(stddev_pop(n_orders), 1.0::DOUBLE) AS std FROM daily GROUP BY 1) SELECT series, ds, round((n_orders - mu) / std, 7) + 0.0 AS x FROM daily JOIN r USING (series)")
def _(spark, sf_dir):
    rows = daily(spark, sf_dir)
    return rows.join(prepare.regressor_stats(rows, KEY, "n_orders"), KEY).select("series", "ds", rnd((F.col("n_orders") - F.col("mu")) / F.col("std"), 7).alias("x"))


_WEEK = [f"{f}({2 * 3.141592653589793 * k!r}::DOUBLE * days / 7.0::DOUBLE)" for k in (1, 2, 3) for f in ("sin", "cos")]
_CELLS = [(i, j) for i in range(6) for j in range(i, 7)]


@query(
    "gram_matrix",
    f"WITH {DAILY}, {TIMED}, x AS (SELECT {', '.join(f'{e} AS x{i}' for i, e in enumerate(_WEEK))}, ys AS x6 FROM timed) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(x{i} * x{j}), 4) + 0.0 AS value FROM x" for i, j in _CELLS),
)
def _(spark, sf_dir):
    terms = X.fourier_terms(F.col("days"), 7.0, 3)
    rows = timed(spark, sf_dir).select(*(term.alias(f"x{i}") for i, term in enumerate(terms)), F.col("ys"))
    return gram.normal_equations(rows, [f"x{i}" for i in range(6)], "ys").withColumn("value", rnd("value", 4))


# Changepoints and trends


@query(
    "auto_changepoints",
    f"""WITH {DAILY}, {TIMED}, r AS (SELECT series, t, n, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS place, floor((n - 1) * 0.8::DOUBLE)::INT AS e FROM timed),
w AS (SELECT DISTINCT series, least(greatest(round(i * e / 16.0::DOUBLE)::INT, 1), e - 1) AS place FROM (SELECT DISTINCT series, n, e FROM r WHERE n > 2 AND e > 1), range(1, 16) g(i))
SELECT series, place, round(t, 9) AS t FROM r JOIN w USING (series, place)""",
)
def _(spark, sf_dir):
    return prepare.auto_changepoints(daily(spark, sf_dir), KEY).select("series", "place", rnd("t", 9).alias("t"))


_DATES = ("1996-03-01", "1998-07-15", "not a date", "1990-01-01", "2000-02-29")


@query("manual_changepoints", f"WITH {DAILY}, {TIMED} SELECT DISTINCT s.series, round(date_diff('microsecond', t0, c) / 1e6::DOUBLE / t_scale, 9) AS t FROM s, (VALUES (TIMESTAMP '1996-03-01'), (TIMESTAMP '1998-07-15'), (TIMESTAMP '2000-02-29')) v(c) WHERE c BETWEEN t0 AND t_last")
def _(spark, sf_dir):
    return prepare.manual_changepoints(prepare.scales(daily(spark, sf_dir), KEY), KEY, _DATES).select("series", rnd("t", 9).alias("t"))


@query(
    "adaptive_settings",
    "SELECT l_suppkey AS series, n_obs, CASE WHEN n_obs >= 75000 THEN 10 WHEN n_obs >= 25000 THEN 15 WHEN n_obs >= 10000 THEN 20 ELSE 25 END AS n_changepoints, CASE WHEN n_obs >= 75000 THEN 0.02 WHEN n_obs >= 25000 THEN 0.03 WHEN n_obs >= 10000 THEN 0.04 ELSE 0.05 END::DOUBLE AS tau FROM (SELECT l_suppkey, count(*) * 100 AS n_obs FROM lineitem GROUP BY 1)",
)
def _(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("series")).agg((F.count("*") * 100).alias("n_obs"))
    n, tau = prepare.adaptive(F.col("n_obs"), 25, 0.05)
    return counts.select("series", "n_obs", n.alias("n_changepoints"), tau.alias("tau"))


_S, _D = frozen.T_CHANGE, frozen.DELTA
_ARRAYS = lambda: (F.array(*map(F.lit, _S)), F.array(*map(F.lit, _D)))


@query("changepoint_matrix", f"WITH {DAILY}, {TIMED} SELECT series, ds, j, CASE WHEN t >= s THEN 1.0::DOUBLE ELSE 0.0 END AS a FROM timed, (VALUES (0, 0.2::DOUBLE), (1, 0.5), (2, 0.8)) v(j, s)")
def _(spark, sf_dir):
    return timed(spark, sf_dir).select("series", "ds", F.posexplode(X.changepoint_row(F.col("t"), _ARRAYS()[0])).alias("j", "a"))


def _trend(rows: DataFrame, growth: str) -> Column:
    s, d = _ARRAYS()
    k, m = F.lit(0.5), F.lit(0.2)
    rates, offsets = X.trend_arrays(growth, k, m, d, s, X.logistic_gamma(k, m, d, s))
    n = X.active(F.col("t"), s)
    return X.piecewise_linear(F.col("t"), rates, offsets, n) if growth == "linear" else X.piecewise_logistic(F.col("t"), F.lit(2.0), rates, offsets, n)


_RATE = "(0.5::DOUBLE + CASE WHEN t >= 0.2 THEN 0.3 ELSE 0 END + CASE WHEN t >= 0.5 THEN -0.5 ELSE 0 END + CASE WHEN t >= 0.8 THEN 0.2 ELSE 0 END)"
_GAMMA = frozen.gamma(Config(growth="logistic"), 0)


@query("trend_linear", f"WITH {DAILY}, {TIMED} SELECT series, ds, round({_RATE} * t + 0.2::DOUBLE + CASE WHEN t >= 0.2 THEN -0.06 ELSE 0 END + CASE WHEN t >= 0.5 THEN 0.25 ELSE 0 END + CASE WHEN t >= 0.8 THEN -0.16 ELSE 0 END, 8) AS trend FROM timed")
def _(spark, sf_dir):
    rows = timed(spark, sf_dir)
    return rows.select("series", "ds", rnd(_trend(rows, "linear"), 8).alias("trend"))


@query(
    "trend_logistic",
    f"WITH {DAILY}, {TIMED} SELECT series, ds, round(2.0::DOUBLE / (1 + exp(-{_RATE} * (t - (0.2::DOUBLE" + "".join(f" + CASE WHEN t >= {s} THEN {g!r}::DOUBLE ELSE 0 END" for s, g in zip(_S, _GAMMA, strict=True)) + ")))), 8) AS trend FROM timed",
)
def _(spark, sf_dir):
    rows = timed(spark, sf_dir)
    return rows.select("series", "ds", rnd(_trend(rows, "logistic"), 8).alias("trend"))


@query(
    "logistic_gamma",
    f"""WITH RECURSIVE {DAILY}, {TIMED}, cp(j, s, d) AS (VALUES (1, 0.2::DOUBLE, 0.3::DOUBLE), (2, 0.5, -0.5), (3, 0.8, 0.2)),
z AS (SELECT series, avg(ys) AS k FROM timed GROUP BY 1),
g(series, j, k, m, gamma) AS (SELECT series, 0, k, 0.2::DOUBLE, 0.0::DOUBLE FROM z UNION ALL
  SELECT g.series, cp.j, g.k + d, g.m + (s - g.m) * (1 - CASE WHEN abs(g.k + d) <= 1e-12 THEN 0 ELSE g.k / (g.k + d) END), (s - g.m) * (1 - CASE WHEN abs(g.k + d) <= 1e-12 THEN 0 ELSE g.k / (g.k + d) END) FROM g JOIN cp ON cp.j = g.j + 1)
SELECT series, j - 1 AS i, round(gamma, 7) + 0.0 AS gamma FROM g WHERE j > 0""",
)
def _(spark, sf_dir):
    s, d = _ARRAYS()
    rates = timed(spark, sf_dir).groupBy("series").agg(F.avg("ys").alias("k"))
    return rates.select("series", F.posexplode(X.logistic_gamma(F.col("k"), F.lit(0.2), d, s)).alias("i", "gamma")).withColumn("gamma", rnd("gamma", 7))


@query("trend_flat", f"WITH {DAILY}, {TIMED} SELECT series, ds, round(avg(ys) OVER (PARTITION BY series), 8) AS trend FROM timed")
def _(spark, sf_dir):
    rows = timed(spark, sf_dir)
    return rows.join(prepare.y_stats(rows, KEY), KEY).select("series", "ds", rnd("mean", 8).alias("trend"))


_ENDS = f"WITH {DAILY}, {TIMED}, e AS (SELECT series, arg_min(ys, ds) AS y0, arg_max(ys, ds) AS y1, avg(ys) AS mean FROM timed GROUP BY 1)"


@query("init_linear", _ENDS + " SELECT series, round(y1 - y0, 8) + 0.0 AS k, round(y0, 8) AS m FROM e")
def _(spark, sf_dir):
    found = prepare.ends(timed(spark, sf_dir), KEY)
    return found.select("series", rnd(F.col("y1") - F.col("y0"), 8).alias("k"), rnd("y0", 8).alias("m"))


@query(
    "init_logistic",
    _ENDS
    + """, r AS (SELECT *, 1.2::DOUBLE / greatest(0.012::DOUBLE, least(1.188::DOUBLE, y0)) AS r0, 1.2::DOUBLE / greatest(0.012::DOUBLE, least(1.188::DOUBLE, y1)) AS r1 FROM e),
l AS (SELECT series, ln(CASE WHEN abs(r0 - r1) <= 0.01 THEN 1.05::DOUBLE * r0 ELSE r0 END - 1) AS l0, ln(r1 - 1) AS l1 FROM r)
SELECT series, round(l0 - l1, 6) + 0.0 AS k, round(l0 / (l0 - l1), 6) + 0.0 AS m FROM l""",
)
def _(spark, sf_dir):
    found = prepare.ends(timed(spark, sf_dir).withColumns({"cap": F.lit(1.2), "cs": F.lit(1.2)}), KEY)
    k, m = prepare.logistic_start(F.col("y0"), F.col("y1"), F.col("c0"), F.col("c1"), F.lit(1.0), F.col("mean"))
    return found.select("series", rnd(k).alias("k"), rnd(m).alias("m"))


@query("init_flat", _ENDS + " SELECT series, 0.0::DOUBLE AS k, round(mean, 8) AS m FROM e")
def _(spark, sf_dir):
    return prepare.ends(timed(spark, sf_dir), KEY).select("series", F.lit(0.0).alias("k"), rnd("mean", 8).alias("m"))


@query(
    "delta_slopes",
    f"""WITH {DAILY}, {TIMED}, r AS (SELECT series, t, ys, n, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i, least(greatest(n // 20, 3), 50) AS w, max_by(ys, ds) OVER (PARTITION BY series) - min_by(ys, ds) OVER (PARTITION BY series) AS k FROM timed),
a AS (SELECT series, j, n, w, k, min(i) AS pos FROM r, (VALUES (0, 0.2::DOUBLE), (1, 0.5), (2, 0.8)) v(j, s) WHERE t >= s GROUP BY ALL),
p AS (SELECT a.*, b1.ys AS yb1, b1.t AS tb1, b0.ys AS yb0, b0.t AS tb0, a1.ys AS ya1, a1.t AS ta1, a0.ys AS ya0, a0.t AS ta0 FROM a
  JOIN r b1 ON b1.series = a.series AND b1.i = pos - 1 JOIN r b0 ON b0.series = a.series AND b0.i = greatest(pos - a.w, 0)
  JOIN r a0 ON a0.series = a.series AND a0.i = pos JOIN r a1 ON a1.series = a.series AND a1.i = least(pos + a.w, a.n) - 1 WHERE pos > 0 AND pos < a.n - 1)
SELECT series, j, round(least(greatest((ya1 - ya0) / (ta1 - ta0) - (yb1 - yb0) / (tb1 - tb0), -(abs(k) * 0.5 + 0.1)), abs(k) * 0.5 + 0.1), 6) + 0.0 AS delta FROM p""",
)
def _(spark, sf_dir):
    return prepare.delta_start(timed(spark, sf_dir), KEY, _S).withColumn("delta", rnd("delta"))


# Features


def _fourier_sql(period: float, order: int, source: str = "timed", when: str = "") -> str:
    terms = [f"{f}({2 * 3.141592653589793 * k!r}::DOUBLE * days / {period!r}::DOUBLE)" for k in range(1, order + 1) for f in ("sin", "cos")]
    value = f"list_value({', '.join(terms)})[i + 1]"
    value = f"CASE WHEN {when} THEN {value} ELSE 0 END" if when else value
    return f"SELECT series, ds, i::INT AS i, round({value}, 6) + 0.0 AS x FROM {source}, range(0, {2 * order}) g(i)"


def _fourier(rows: DataFrame, period: float, order: int, when: Column | None = None) -> DataFrame:
    terms = X.fourier_terms(F.col("days"), period, order)
    if when is not None:
        terms = [F.when(when, x).otherwise(0.0) for x in terms]
    return rows.select("series", "ds", F.posexplode(F.array(*terms)).alias("i", "x")).withColumn("x", rnd("x"))


HOURS = "s AS (SELECT series, min(ds) AS t0 FROM hourly GROUP BY 1), timed AS (SELECT h.*, date_diff('second', t0, ds) / 86400.0::DOUBLE AS days FROM hourly h JOIN s USING (series))"


@query("fourier_weekly", f"WITH {DAILY}, {TIMED} {_fourier_sql(7.0, 3)}")
def _(spark, sf_dir):
    return _fourier(timed(spark, sf_dir), 7.0, 3)


@query("fourier_yearly", f"WITH {DAILY}, {TIMED} {_fourier_sql(365.25, 10)}")
def _(spark, sf_dir):
    return _fourier(timed(spark, sf_dir), 365.25, 10)


@query("fourier_daily_hourly", f"WITH {HOURLY}, {HOURS} {_fourier_sql(1.0, 4)}")
def _(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return _fourier(rows.join(prepare.scales(rows, KEY), KEY).withColumn("days", X.days_since(F.col("ds"), F.col("t0"))), 1.0, 4)


@query("fourier_custom", f"WITH {DAILY}, {TIMED} {_fourier_sql(30.5, 5)}")
def _(spark, sf_dir):
    return _fourier(timed(spark, sf_dir), 30.5, 5)


@query("fourier_conditional", f"WITH {DAILY}, {TIMED} {_fourier_sql(7.0, 2, when='month(ds) IN (6, 7, 8)')}")
def _(spark, sf_dir):
    return _fourier(timed(spark, sf_dir), 7.0, 2, F.month("ds").isin(6, 7, 8))


_HOLIDAYS = Holiday("new_year", ("1996-01-01", "1997-01-01", "1998-01-01"), -1, 1)


@query("holiday_features", f"WITH {DAILY} SELECT series, ds, h::VARCHAR AS holiday, date_diff('day', h, ds::DATE) AS day FROM daily, (VALUES (DATE '1996-01-01'), (DATE '1997-01-01'), (DATE '1998-01-01')) v(h) WHERE date_diff('day', h, ds::DATE) BETWEEN -1 AND 1")
def _(spark, sf_dir):
    days = F.array(*(F.lit(d) for d in _HOLIDAYS.dates))
    calendar_ = spark.range(1).select(F.explode(days).alias("holiday"), F.lit(-1).alias("low"), F.lit(1).alias("high"))
    # The calendar has a row for each date of the configuration: a bounded range join.
    gap = F.datediff(F.col("ds").cast("date"), F.col("holiday").cast("date"))
    return daily(spark, sf_dir).join(F.broadcast(calendar_), gap.between(F.col("low"), F.col("high"))).select("series", "ds", "holiday", gap.cast("bigint").alias("day"))


@query(
    "design_matrix_long",
    f"WITH {DAILY}, {TIMED}, x AS (SELECT series, ds, list_value({', '.join(_WEEK)}, " + ", ".join(f"CASE WHEN ds::DATE = DATE '{d}' THEN 1.0::DOUBLE ELSE 0.0 END" for d in _HOLIDAYS.dates) + ", (n_orders - 4.0::DOUBLE) / 2.0::DOUBLE) AS x FROM timed) SELECT series, ds, i::INT AS i, round(x[i + 1], 6) + 0.0 AS x FROM x, range(0, 10) g(i)",
)
def _(spark, sf_dir):
    row = X.design_row(X.fourier_terms(F.col("days"), 7.0, 3), X.holiday_terms(F.col("ds"), _HOLIDAYS.dates, 0, 0), [(F.col("n_orders") - 4.0) / 2.0])
    return timed(spark, sf_dir).select("series", "ds", F.posexplode(row).alias("i", "x")).withColumn("x", rnd("x"))


# Prediction with given parameters


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("series", "ds", *(rnd(c, 4).alias(c) for c in FORECAST_COLUMNS[1:]))


def _predict_query(name: str, config: Config, source: str = "daily", extra: str = "", columns: Callable[[DataFrame], DataFrame] = lambda df: df, sql: str = "", cap: str = "", floor: str = ""):
    """Prediction of the daily frame by the frozen model of ``config``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = columns(daily(spark, sf_dir))
        return _rounded(predicting.predict(prepare.coerce(rows, config, KEY, training=False), frozen.params(spark, config), config, KEY))

    query(name, f"WITH {DAILY}{sql}" + frozen.sql_predict(config, source, extra, cap, floor))(run)


_ADDITIVE = Config()
_predict_query("predict_linear", _ADDITIVE)
_predict_query("predict_flat", Config(growth="flat", yearly_seasonality=False))
_predict_query("predict_multiplicative", Config(seasonality_mode="multiplicative"))
_predict_query("predict_mixed_modes", Config(weekly_seasonality=True, yearly_seasonality=False).with_seasonality(Seasonality("monthly", 30.5, 4, mode="multiplicative")))
_predict_query("predict_holiday", Config(yearly_seasonality=False).with_holiday(Holiday("peak", ("1996-12-25", "1997-12-25"), -1, 2)))
_predict_query("predict_regressor", Config(yearly_seasonality=False).with_regressor(Regressor("n_orders")).with_regressor(Regressor("promo", mode="multiplicative")), "source", columns=lambda df: df.withColumn("promo", F.when(F.dayofmonth("ds") <= 7, 5.0).otherwise(4.0)), sql=", source AS (SELECT *, CASE WHEN day(ds) <= 7 THEN 5.0::DOUBLE ELSE 4.0 END AS promo FROM daily)")
_predict_query("predict_conditional", Config(weekly_seasonality=False, yearly_seasonality=False).with_seasonality(Seasonality("summer_week", 7.0, 3, condition_name="summer")), "source", columns=lambda df: df.withColumn("summer", F.month("ds").isin(6, 7, 8)), sql=", source AS (SELECT *, month(ds) IN (6, 7, 8) AS summer FROM daily)")
_predict_query("predict_logistic_floor", Config(growth="logistic", yearly_seasonality=False), "source", columns=lambda df: df.withColumns({"cap": F.when(F.dayofmonth("ds") <= 20, 4e6), "floor": F.when(F.dayofmonth("ds") >= 10, 5e4)}), sql=", source AS (SELECT *, CASE WHEN day(ds) <= 20 THEN 4e6::DOUBLE END AS cap, CASE WHEN day(ds) >= 10 THEN 5e4::DOUBLE END AS floor FROM daily)", cap="cap", floor="floor")


@query(
    "predict_intervals",
    f"WITH {DAILY}, w(width, z) AS (VALUES (0.8::DOUBLE, 1.28::DOUBLE), (0.9, 1.645), (0.95, 1.96), (0.99, 2.576)) SELECT width, round(2 * z * 0.05::DOUBLE * 1e6::DOUBLE, 4) AS spread, count(*) AS n FROM w, daily GROUP BY ALL",
)
def _(spark, sf_dir):
    rows = prepare.coerce(daily(spark, sf_dir), _ADDITIVE, KEY, training=False)
    found = [predicting.predict(rows, frozen.params(spark, Config(interval_width=w)), Config(interval_width=w), KEY).select(F.lit(w).alias("width"), F.round(F.col("yhat_upper") - F.col("yhat_lower"), 4).alias("spread")) for w in (0.8, 0.9, 0.95, 0.99)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.groupBy("width", "spread").agg(F.count("*").alias("n"))


_FUTURE = ", future AS (SELECT series, CAST(date_trunc('day', max(ds)) AS TIMESTAMP) + to_days(i::INT) AS ds FROM daily, range(1, 91) g(i) GROUP BY series, i)"


@query("predict_multi_series", f"WITH {DAILY}{_FUTURE}" + frozen.sql_predict(_ADDITIVE, "future"))
def _(spark, sf_dir):
    future = calendar.make_future(daily(spark, sf_dir), 90, "D", KEY, include_history=False)
    return _rounded(predicting.predict(future, frozen.params(spark, _ADDITIVE), _ADDITIVE, KEY))


# Calendar


def _future_query(name: str, freq: str, periods: int, step: str, sql_start: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return calendar.make_future(hourly(spark, sf_dir), periods, freq, KEY, include_history=False)

    query(name, f"WITH {HOURLY}, l AS (SELECT series, {sql_start} AS last FROM hourly GROUP BY 1) SELECT series, last + {step} AS ds FROM l, range(1, {periods + 1}) g(i)")(run)


_DAY_START = "CAST(date_trunc('day', max(ds)) AS TIMESTAMP)"
_future_query("future_h", "H", 48, "to_hours(i::INT)", "max(ds)")
_future_query("future_d", "D", 30, "to_days(i::INT)", _DAY_START)
_future_query("future_w", "w", 12, "to_days((7 * i)::INT)", _DAY_START)
_future_query("future_m", "M", 12, "to_days((30 * i)::INT)", _DAY_START)
_future_query("future_y", "Y", 3, "to_days((365 * i)::INT)", _DAY_START)
_future_query("future_unknown", "MS", 12, "to_days(i::INT)", _DAY_START)


@query("future_with_history", f"WITH {DAILY} SELECT series, ds FROM daily UNION ALL SELECT series, CAST(date_trunc('day', max(ds)) AS TIMESTAMP) + to_days(i::INT) FROM daily, range(1, 31) g(i) GROUP BY series, i")
def _(spark, sf_dir):
    return calendar.make_future(daily(spark, sf_dir), 30, "D", KEY)


# Introspection and errors

_WITH_REGRESSORS = Config(yearly_seasonality=False).with_regressor(Regressor("n_orders", 5.0)).with_regressor(Regressor("promo", mode="multiplicative"))


def _coefficient_sql() -> str:
    own = frozen.blocks(_WITH_REGRESSORS)
    b = frozen.beta(own[-1]["end"])
    rows = [(x["name"], x["mode"], b[x["start"]] * (frozen.Y_SCALE if x["mode"] == "additive" else 1.0) / 2.0, x["prior_scale"]) for x in own if x["kind"] == "regressor"]
    return "SELECT DISTINCT o_orderpriority AS series, v.* FROM orders, (VALUES " + ", ".join(f"('{n}', '{m}', 4.0::DOUBLE, 2.0::DOUBLE, round({c!r}::DOUBLE, 6), {p!r}::DOUBLE)" for n, m, c, p in rows) + ") v(regressor, regressor_mode, center, std, coef, prior_scale)"


@query("regressor_coefficients", _coefficient_sql())
def _(spark, sf_dir):
    own = prepare.distinct_series(daily(spark, sf_dir), KEY)
    return regressor_coefficients(frozen.params(spark, _WITH_REGRESSORS).join(own, KEY), KEY).withColumn("coef", rnd("coef"))


@query(
    "forecast_metrics",
    f"WITH {DAILY}, p AS (SELECT series, y, lag(y, 7) OVER (PARTITION BY series ORDER BY ds) AS yhat FROM daily), e AS (SELECT * FROM p WHERE yhat IS NOT NULL) SELECT series, count(*) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse, round(avg(abs(y - yhat)), 4) AS mae, round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 6) AS r2 FROM e GROUP BY 1",
)
def _(spark, sf_dir):
    naive = daily(spark, sf_dir).withColumn("yhat", F.lag("y", 7).over(Window.partitionBy("series").orderBy("ds"))).filter("yhat IS NOT NULL")
    return metrics.errors(naive, KEY).select("series", "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), rnd("r2").alias("r2"))


@query("forecast_difference", f"WITH {DAILY}, d AS (SELECT series, ds, y AS p, y + n_orders AS q FROM daily) SELECT series, round(avg(abs(p - q)), 6) AS mean_abs, round(max(abs(p - q)), 6) AS max_abs, round(avg(abs(p - q)) / avg(abs(p)), 9) AS relative FROM d GROUP BY 1")
def _(spark, sf_dir):
    rows = daily(spark, sf_dir)
    found = metrics.difference(rows.select("series", "ds", F.col("y").alias("yhat")), rows.select("series", "ds", (F.col("y") + F.col("n_orders")).alias("yhat")), KEY)
    return found.select("series", rnd("mean_abs").alias("mean_abs"), rnd("max_abs").alias("max_abs"), rnd("relative", 9).alias("relative"))


# Fits.  Where a model has no features and no changepoints SQL finds the estimate too; for the others it finds what a fit
# takes from the data (scales, changepoint places, sizes, errors), and the tests check parameters, objectives and invariances.


def _fit_facts_sql(frame: str, source: str = "", features: str = "0", config: Config = Config(), y: str = "y", places: str | None = None) -> str:
    """SQL of :func:`_fit_facts`: ``features`` is the number of coefficients, given span_days and n."""
    count = config.n_changepoints
    share, tau = f"{config.changepoint_range!r}::DOUBLE", f"{config.changepoint_prior_scale!r}::DOUBLE"
    number = f"CASE WHEN n >= 75000 THEN {min(count, 10)} WHEN n >= 25000 THEN {min(count, 15)} WHEN n >= 10000 THEN {min(count, 20)} ELSE {count} END"
    scale = f"CASE WHEN n >= 75000 THEN least({tau}, 0.02) WHEN n >= 25000 THEN least({tau}, 0.03) WHEN n >= 10000 THEN least({tau}, 0.04) ELSE {tau} END"
    changes = places or "list_sort(list_distinct(list_transform(range(1, c + 1), lambda i: ts[least(greatest(floor(i * e / (c + 1)::DOUBLE + 0.5)::BIGINT, 1), e - 1) + 1])))"
    none = "len(list_filter([1], lambda x: true)) = 0" if places else f"n <= 2 OR c = 0 OR e <= 1 OR '{config.growth}' = 'flat'"
    return f"""WITH {frame}, rows AS (SELECT * FROM {source or "daily"}),
f AS (SELECT series, count(*) AS n, min(ds) AS t0, max(ds) AS t_last, greatest(max(abs({y})), 1.0::DOUBLE) AS y_scale, date_diff('second', min(ds), max(ds)) // 86400 AS span_days,
  greatest(date_diff('microsecond', min(ds), max(ds)) / 1e6::DOUBLE, 1e-12::DOUBLE) AS t_scale FROM rows GROUP BY 1),
l AS (SELECT series, list(date_diff('microsecond', t0, ds) / 1e6::DOUBLE / t_scale ORDER BY ds) AS ts FROM rows JOIN f USING (series) GROUP BY 1),
g AS (SELECT *, {number} AS c, floor((n - 1) * {share})::BIGINT AS e FROM f JOIN l USING (series)),
h AS (SELECT *, CASE WHEN {none} THEN [] ELSE {changes} END AS s FROM g)
SELECT series, n AS n_obs, '{config.growth}' AS growth, t0, t_last, round(y_scale, 4) AS y_scale, round({scale}, 9) AS tau, len(s)::INT AS changepoints, round(coalesce(list_sum(s), 0), 7) + 0.0 AS places,
  ({features})::INT AS features, TRUE AS converged, TRUE AS finite, NULL::VARCHAR AS error FROM h"""


def _fit_facts(params: DataFrame) -> DataFrame:
    total = lambda name: F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    finite = F.forall(F.concat(F.array("k", "m", "sigma_obs", "objective"), "delta", "beta"), lambda x: F.abs(x) < 1e9) & (F.size("delta") == F.size("t_change")) & (F.col("sigma_obs") > 0)
    return params.select(
        "series", "n_obs", "growth", "t0", "t_last", F.round("y_scale", 4).alias("y_scale"), F.round("changepoint_prior_scale", 9).alias("tau"), F.size("t_change").alias("changepoints"),
        rnd(total("t_change"), 7).alias("places"), F.size("beta").alias("features"), "converged", finite.alias("finite"), "error",
    )


_YEARLY = "CASE WHEN span_days >= 730 THEN 20 ELSE 0 END"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value by priority: fitted and forecast 30 days ahead."""
    return Forecaster().fit(daily(spark, sf_dir), KEY).predict(periods=30)


query("forecast_30_days")(flagship)


def _line_sql(frame: str, flat: bool = False, weight: str = "1.0::DOUBLE") -> str:
    """The estimate of a model without features and changepoints: a ridge system of two unknowns and sigma, in turn."""
    t = "0.0::DOUBLE" if flat else "t"
    return f"""WITH RECURSIVE {frame}, {TIMED},
p AS (SELECT series, {t} AS t, ys AS y, {weight} AS w FROM timed),
g AS (SELECT series, count(*) AS n, sum(w) AS w, sum(w * t * t) AS tt, sum(w * t) AS t1, sum(w) AS ww, sum(w * t * y) AS ty, sum(w * y) AS y1, sum(w * y * y) AS yy FROM p GROUP BY 1),
step(series, i, k, m, sigma) AS (
  SELECT series, 0, 0.0::DOUBLE, 0.0::DOUBLE, sqrt(2 * yy / (w + sqrt(w * w + 16 * yy))) FROM g
  UNION ALL
  SELECT series, i + 1, k, m, sqrt(2 * sse / (w + sqrt(w * w + 16 * sse))) FROM (
    SELECT series, i, w, k, m, yy - 2 * (k * ty + m * y1) + k * k * tt + 2 * k * m * t1 + m * m * ww AS sse FROM (
      SELECT g.* EXCLUDE (k, m), (ty * (ww + 0.04 * sigma * sigma) - y1 * t1) / det AS k, (y1 * (tt + 0.04 * sigma * sigma) - ty * t1) / det AS m FROM (
        SELECT *, (tt + 0.04 * sigma * sigma) * (ww + 0.04 * sigma * sigma) - t1 * t1 AS det FROM step JOIN g USING (series) WHERE i < 60
      ) g
    )
  )
)
SELECT series, n AS n_obs, round(k, 6) + 0.0 AS k, round(m, 6) + 0.0 AS m, round(sigma, 6) AS sigma_obs, TRUE AS converged FROM step JOIN g USING (series) WHERE i = 60"""


def _line(params: DataFrame) -> DataFrame:
    return params.select("series", "n_obs", rnd("k").alias("k"), rnd("m").alias("m"), F.round("sigma_obs", 6).alias("sigma_obs"), "converged")


_PLAIN = {"n_changepoints": 0, "yearly_seasonality": False, "weekly_seasonality": False}


@query("fit_line", _line_sql(DAILY))
def _(spark, sf_dir):
    return _line(fitting.fit(daily(spark, sf_dir), Config(**_PLAIN), KEY))


@query("fit_line_weighted", _line_sql(DAILY, weight="n_orders::DOUBLE"))
def _(spark, sf_dir):
    return _line(fitting.fit(daily(spark, sf_dir).withColumn("weight", F.col("n_orders").cast("double")), Config(**_PLAIN), KEY))


@query("fit_level", _line_sql(DAILY, flat=True))
def _(spark, sf_dir):
    return _line(fitting.fit(daily(spark, sf_dir), Config(growth="flat", **_PLAIN), KEY))


@query("fit_linear", _fit_facts_sql(DAILY, features=f"{_YEARLY} + 6"))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(daily(spark, sf_dir), Config(), KEY))


@query("fit_multi", _fit_facts_sql(SHIPPED, "shipped", f"{_YEARLY} + 6"))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(shipped(spark, sf_dir), Config(), KEY))


@query("fit_hourly", _fit_facts_sql(HOURLY, "hourly", f"{_YEARLY} + 6 + 8"))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(hourly(spark, sf_dir), Config(daily_seasonality=True), KEY))


_LOGISTIC = Config(growth="logistic", yearly_seasonality=False, n_changepoints=5)


@query("fit_logistic", _fit_facts_sql(HOURLY, "hourly", "6", _LOGISTIC))
def _(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return _fit_facts(fitting.fit(rows.join(rows.groupBy("series").agg((F.max("y") * 1.2).alias("cap")), KEY), _LOGISTIC, KEY))


@query("fit_flat", _fit_facts_sql(DAILY, features=f"{_YEARLY} + 6", config=Config(growth="flat")))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(daily(spark, sf_dir), Config(growth="flat"), KEY))


@query("fit_multiplicative", _fit_facts_sql(SHIPPED, "shipped", f"{_YEARLY} + 6"))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(shipped(spark, sf_dir), Config(seasonality_mode="multiplicative"), KEY))


@query("fit_weighted", _fit_facts_sql(DAILY, features=f"{_YEARLY} + 6"))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(daily(spark, sf_dir).withColumn("weight", F.col("n_orders").cast("double")), Config(), KEY))


@query("fit_holidays", _fit_facts_sql(DAILY, features=f"{_YEARLY} + 6 + 9"))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(daily(spark, sf_dir), Config().with_holiday(_HOLIDAYS), KEY))


@query("fit_pooled_holidays", _fit_facts_sql(DAILY, features=f"{_YEARLY} + 6 + 3"))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(daily(spark, sf_dir), Config(pool_holidays=True).with_holiday(_HOLIDAYS), KEY))


@query("fit_regressors", f"WITH {DAILY} SELECT series, 'n_orders' AS regressor, 'additive' AS regressor_mode, round(avg(n_orders), 8) AS center, round(greatest(stddev_pop(n_orders), 1.0::DOUBLE), 8) AS std, 10.0::DOUBLE AS prior_scale, TRUE AS positive FROM daily GROUP BY 1")
def _(spark, sf_dir):
    """More orders make a day's value larger, so the coefficient is positive."""
    found = regressor_coefficients(fitting.fit(daily(spark, sf_dir), Config().with_regressor(Regressor("n_orders")), KEY), KEY)
    return found.select("series", "regressor", "regressor_mode", F.round("center", 8).alias("center"), F.round("std", 8).alias("std"), "prior_scale", (F.col("coef") > 0).alias("positive"))


_GIVEN = "list_sort(list_filter(list_transform([TIMESTAMP '1996-03-01', TIMESTAMP '1998-07-15', TIMESTAMP '1990-01-01', TIMESTAMP '2000-02-29'], lambda x: date_diff('microsecond', t0, x) / 1e6::DOUBLE / t_scale), lambda x: x BETWEEN 0 AND 1))"


@query("fit_manual_changepoints", _fit_facts_sql(DAILY, features=f"{_YEARLY} + 6", places=_GIVEN))
def _(spark, sf_dir):
    return _fit_facts(fitting.fit(daily(spark, sf_dir), Config(changepoints=_DATES), KEY))


@query(
    "fit_partial_failure",
    f"WITH {DAILY} SELECT series, count(*) AS n_obs, NULL::VARCHAR AS error FROM daily GROUP BY 1 UNION ALL SELECT DISTINCT 'lone ' || series, 1, 'Dataframe has less than 2 non-NaN rows' FROM daily",
)
def _(spark, sf_dir):
    rows = daily(spark, sf_dir)
    lone = rows.groupBy(F.concat(F.lit("lone "), "series").alias("series")).agg(F.min("ds").alias("ds"), F.min_by("y", "ds").alias("y"))
    return fitting.fit(rows.select("series", "ds", "y").unionByName(lone), Config(), KEY).select("series", "n_obs", "error")


@query("fit_large_series", "SELECT count(*) AS n_obs, TRUE AS agrees, TRUE AS converged FROM events")
def _(spark, sf_dir):
    """One series fitted from sums over the cluster, beside the same one fitted in one worker."""
    rows, config = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("ds"), F.col("value").alias("y")), Config(daily_seasonality=True)
    one, two = (x.select("n_obs", "k", "m", "sigma_obs", "objective", "converged") for x in (gram.fit_large_params(rows, config), fitting.fit(rows, config)))
    other = two.toDF(*(f"{c}_2" for c in two.columns))
    near = lambda c: F.abs(F.col(c) - F.col(f"{c}_2")) <= 1e-3 * (1 + F.abs(f"{c}_2"))
    return one.join(other, F.col("n_obs") == F.col("n_obs_2")).select("n_obs", (near("k") & near("m") & near("sigma_obs") & near("objective")).alias("agrees"), "converged")


@query(
    "backtest",
    f"WITH {DAILY}, o(cutoff) AS (VALUES (TIMESTAMP '1999-01-01'), (TIMESTAMP '2000-01-01')) SELECT series, cutoff, count(*) AS n, round(avg(y), 4) AS mean, TRUE AS bounded FROM daily, o WHERE ds > cutoff AND ds <= cutoff + INTERVAL 60 DAY GROUP BY 1, 2",
)
def _(spark, sf_dir):
    """Forecast errors of two origins; no forecast may be worse than twice the spread of what it is held against."""
    ahead = metrics.backtest(daily(spark, sf_dir), Config(), ("1999-01-01", "2000-01-01"), 60, KEY)
    own = [*KEY, "cutoff"]
    spread = ahead.groupBy(*own).agg(F.round(F.avg("y"), 4).alias("mean"), F.stddev_pop("y").alias("std"))
    return metrics.errors(ahead, own).join(spread, own).select(*own, "n", "mean", (F.col("rmse") <= 2 * F.col("std")).alias("bounded"))


@query("json_roundtrip", f"WITH {DAILY} SELECT series, 7::BIGINT AS n, 0::BIGINT AS differing FROM daily GROUP BY 1")
def _(spark, sf_dir):
    """Forecasts of a model and of the same one written as JSON and read again."""
    fitted = Forecaster().fit(daily(spark, sf_dir), KEY)
    back = _from_params(store.from_json(store.to_json(fitted.params_df), [fitted.params_df.schema["series"]]), KEY)
    future = fitted.make_future(7, include_history=False)
    both = fitted.predict(future).join(back.predict(future).toDF("series", "ds", *(f"{c}_2" for c in FORECAST_COLUMNS[1:])), ["series", "ds"])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in FORECAST_COLUMNS[1:]]
    return both.groupBy("series").agg(F.count("*").alias("n"), F.count_if(~F.least(*(x.cast("int") for x in same)).cast("boolean")).alias("differing"))

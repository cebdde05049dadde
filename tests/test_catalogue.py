"""Every registered query of the engine against its SQL twin, and the driver's entry."""

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{x:.12g}" if isinstance(x, float) else str(x) for x in row) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in catalogue.ORACLE_SQL:
        want = db.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    if "error" in found.columns and name not in ("fit_partial_failure", "min_rows_check"):
        assert found["error"].isna().all()


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_predict_has_no_python_and_prunes(spark):
    plan = catalogue.QUERIES["predict_multi_series"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "o_totalprice" not in plan  # a forecast reads no values, only dates and keys
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in catalogue.QUERIES["predict_multi_series"](spark, SF)._jdf.queryExecution().toString()

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table; columns of clashing names come along."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCUMENTS)
        if extra:
            for name in ("score", "ids", "n_tokens", "rate", "replica", "sig", "key", "block", "blob_id", "label", "path", "id", "root", "cdf", "_source", "_rate", "_count", "_spans", "_blob", "_score", "_near_row", "whole", "text_", "todo"):
                df = df.selectExpr("*", f"'clash' AS {name}")
        return df

    return make


@pytest.fixture
def sf(spark, tmp_path):
    """Writes tables to a folder and gives its path."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write

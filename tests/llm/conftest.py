import pytest

from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from texts: (text) or (doc_id, text)."""

    def make(*rows, extra: dict | None = None):
        full = [(i, r, "en", "s", len(r or "")) if not isinstance(r, tuple) else (r[0], r[1], "en", "s", len(r[1] or "")) for i, r in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        for name, value in (extra or {}).items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make

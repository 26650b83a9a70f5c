import pytest
from pyspark.sql import functions as F

from sensorframe.runtime import ship

CLASHES = ["a", "b", "key", "node", "component_id", "score", "rep", "label", "_tmp", "kept", "sum", "Digest_A", "found"]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs_of(spark):
    """A documents table with extra columns whose names clash with those used inside."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df

    return make

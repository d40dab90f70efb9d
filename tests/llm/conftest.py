import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),  # clashes with results
        T.StructField("n_bytes", T.StringType()),
        T.StructField("block", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table with extra columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", "y", "z") for i, t, lang in rows], DOCS)

    return make

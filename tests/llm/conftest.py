import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, lang=None):
        full = []
        for r in rows:
            i, text, *rest = r
            full.append((i, text, rest[0] if rest else lang, "s", None if text is None else len(text)))
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make

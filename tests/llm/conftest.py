import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) rows, with the columns of the table and, if asked, others whose names clash."""

    def build(rows, extra=()):
        body = [(i, t, "en", "src0", None if t is None else len(t), *("x" for _ in extra)) for i, t in rows]
        schema = T.StructType(
            [
                T.StructField("doc_id", T.LongType()),
                T.StructField("text", T.StringType()),
                T.StructField("lang", T.StringType()),
                T.StructField("source", T.StringType()),
                T.StructField("n_chars", T.LongType()),
                *(T.StructField(c, T.StringType()) for c in extra),
            ]
        )
        return spark.createDataFrame(body, schema)

    return build

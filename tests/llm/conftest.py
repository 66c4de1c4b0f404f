import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names the operators use within
    T.StructField("row", T.StringType()), T.StructField("spans", T.LongType()), T.StructField("part", T.StringType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of the given texts, or (id, text) pairs, with further columns of clashing names."""
    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", len(t) if t is not None else None, "r", 7, "p") for i, t in rows]
        return spark.createDataFrame(rows, DOCUMENTS)
    return make


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD_TEXTS = [None, "", " ", "\n\t ", "word", "a b c", "same text here", "same text here", "é" * 40, "x" * 5000,
             "tab\tand  double  spaces\r\n\x85\x1c odd 　 ones", "<|endoftext|> inside <|endoftext|><|endof", "😀 字字字 ２３"]

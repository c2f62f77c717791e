import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
# Extra columns, named like columns that operators make.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("node", T.StringType()), T.StructField("kept", T.BooleanType()),
    T.StructField("spans", T.StringType()), T.StructField("host", T.StringType()),
])


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang, source) rows, with extra columns."""
    def make(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", 1, "y", "z", True, "s", None))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


WORDY = " ".join(f"word{i}" for i in range(80))


@pytest.fixture(scope="session")
def edges():
    """Nulls, empty, blank, tiny, long, repeated and tied rows."""
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, WORDY), (6, WORDY), (6, WORDY), (None, WORDY),
        (None, None), (7, "a\x00b é ß\u2028 ½ 中文 \U0001f600"), (8, "ab " * 5000), (9, "x" * 30000),
        (10, WORDY + " and more"), (11, "\n\n\n"), (12, "Line.\r\nline. \n"),
    ]

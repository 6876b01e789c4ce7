import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, node long, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long = " ".join(f"w{i % 977} the of" for i in range(9000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "one two", "xx", None, 7),
            (5, long, "en", "a", len(long)), (6, long, "en", "b", len(long)), (7, "tie " * 60, None, "a", 240),
            (7, "tie " * 60, None, "a", 240), (None, "no id here " * 30, "de", "a", 330), (8, "é🙂\x00\x1c a　b", "fr", "a", 8)]
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select(F.col("doc_id"), "text").collect()]

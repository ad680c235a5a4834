import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = "word " * 60_000 + "a" * 50_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4),
        (4, "Mail bob@example.com or +1 (555) 010-9999 NOW", "en", None, 10),
        (4, "Mail bob@example.com or +1 (555) 010-9999 NOW", "en", None, 10),
        (5, "mail BOB@example.com or +1 (555) 010-9999 now", None, "s", 10),
        (6, long_text, "en", "s", 1), (7, long_text, "en", "s", 1),
        (None, "a row without an id", "en", "s", 1), (8, "été ÄÖÜ 日本語 😀 ▁x\x00y", "fr", "s", 1),
        (9, "!!! 123 ???", "de", "s", 1), (4, "same id, other text", "en", "s", 1),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/labels.parquet")

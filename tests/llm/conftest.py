import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with what the operators must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""
    long = "long " * 60_000
    rows = [
        (1, "The quick brown fox", "en", "a"), (2, "Thequick brown  fox", "en", "a"), (3, "The quick brown fox\n", None, None), (4, None, "en", "b"), (5, "", "en", "b"),
        (6, " \t\n", "de", None), (7, long, "en", "c"), (8, "ünï çödé 日本語   😀 it's we'll", "xx", "d"), (8, "ünï çödé 日本語   😀 it's we'll", "xx", "d"), (9, "a", "en", "a"),
        (10, "one two", "en", "a"), (11, "one two three four five six", None, "a"), (12, "x  y\n\nz\tw\r\n <|endoftext|> tail ", "en", "a"), (-3, "negative id", "en", "a"),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit("clash") for c in ("id", "n", "key", "a", "b", "h128", "kept", "row", "part", "host", "p", "evidence", "bands", "vec", "ids", "words", "length")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def sample(spark):
    """Documents of the smallest tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def sample_texts(sample):
    return {r["doc_id"]: r["text"] or "" for r in sample.select("doc_id", "text").collect()}

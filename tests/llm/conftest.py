import pytest

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    (1, "one two three four five six seven eight", "en", "a", 1),
    (2, "one two three four five six seven eight", "en", "a", 1),  # a copy
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "   \n\t ", "en", "a", 5),
    (6, "word", "en", "a", 4),
    (7, "WORD", "en", "a", 4),
    (None, "no id here at all", None, None, None),
    (8, "long " * 20000 + "tail", "en", "b", 100004),
    (9, "x" * 50000, "en", "b", 50000),
    (10, "repeated row", "en", "b", 12),
    (10, "repeated row", "en", "b", 12),
    (11, "ΟΔΟΣ İzmir 𝒳 naïve é <|endoftext|>   end", "xx", "c", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD_TEXTS, COLUMNS)
    extra = {c: F.lit("mine") for c in ("id", "node", "key", "length", "count", "spans", "n", "component", "_text", "bucket", "unit", "c0", "_id", "_hash", "_spans", "_masked", "_gone", "_repeated", "_chain_toxic", "shard_id", "of_id", "text_hash")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}

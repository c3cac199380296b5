import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, repeated rows, equal texts, a long text, clashing column names."""
    words = " ".join(f"wort{i % 977}" for i in range(60_000))
    passage = "The quick brown fox jumps over the lazy dog and runs away into the dark wood. " * 7
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "ein kurzer Satz", "de", None, 15),
        (4, "ein kurzer Satz", "de", None, 15),
        (5, "12345 !!! ???", None, "a", 13),
        (6, passage, "en", "b", None),
        (7, passage, "en", "b", None),
        (8, "before " + passage + " après", "en", "b", None),
        (9, words, "de", "b", None),
        (None, "no id here at all", "en", "b", None),
        (10, "x" * 5000, None, "b", None),
        (11, "ÄÖ😀 <|endoftext|> naïve\x00\x1c", "fr", "b", None),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("digest", "score", "kept", "spans", "row", "size", "ids", "_digest", "part", "shard"):
        df = df.withColumn(name, df["doc_id"] * 0 - 1)
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


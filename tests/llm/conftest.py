import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def real(spark):
    """The smallest documents as a list of (doc_id, text, source)."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, blank, very long, repeated and tied texts, and columns whose names clash."""
    long = " ".join(f"word{i % 977}" for i in range(60_000)) + ".\n"
    texts = [
        (1, None, "a"), (2, "", None), (3, "   \n\t ", "a"), (4, "one", ""), (5, "one two three", "b"), (6, "one two three", "b"), (6, "one two three", "b"),
        (None, "null id here with some words to count.", "b"), (None, None, None), (7, long, "c"), (8, long + "tail", "c"), (9, "x" * 200_000, "a"), (10, "ab " * 40_000, "é"),
        (11, "Grüße ÄÖÜ ß 💡 ñ́ İstanbul ﬁ １２３ ١٢ '’s don't  <|endoftext|> tail\x1c\x85\xa0z", "a"), (12, "퟿ ​­", "a"),
    ]
    rows = [(i, t, s, "en", len(t or ""), -1, "x", 0.5, 3) for i, t, s in texts]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, lang string, n_chars long, shard int, spans string, score double, size int"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

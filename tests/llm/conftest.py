import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, q_pos string, size string"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, repeated and very long rows, non-ASCII text, and columns with clashing names."""
    texts = [None, "", " \t\n", "one", "one", "a b c d e f g " * 3000, "Ünïcödé 日本語 😀 é  x", "it's <|endoftext|> 12 345 !!\r\n\r\n  ok  ", "\x1c\x85   z"]
    rows = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 3, "x", "y"), (None, "null id", None, None, None, None, None), (99, "x", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)

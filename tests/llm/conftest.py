import pytest

@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, one very long text, and extra columns with names the operators use inside."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", "b", 3), (4, "one two three", "en", "b", 13), (4, "one two three", "en", "b", 13), (None, "no id here", "fr", None, 10), (5, long, "de", "c", len(long))]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, rank int, node string")

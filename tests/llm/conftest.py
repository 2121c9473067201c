import pytest


@pytest.fixture
def documents(spark):
    """A table with nulls, an empty and a long text, ties, repeated rows and columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and runs through the wide green forest until evening falls"
    rows = [
        (3, prose + "\n" + "some other line of words here", "en", "a", 10, 1),
        (1, None, None, None, None, None),
        (2, "", "en", "a", 0, 2),
        (5, prose + "\n" + "some other line of words here", "en", "a", 10, 3),
        (5, prose + "\n" + "some other line of words here", "en", "a", 10, 3),
        (4, "Über  ä\t\n\n x", "de", "b", 9, 4),
        (6, " ".join(f"w{i}x" for i in range(20_000)), "en", "b", 1, 5),
        (None, "a row without an id", "en", None, 19, 6),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long").withColumnRenamed("node", "hash")


@pytest.fixture
def empty(spark, documents):
    return documents.where("false")

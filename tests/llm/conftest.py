import pytest

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rows = [(1, "One fish. Two fish! Red fish?", "en", "a", 29), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, " \n\t ", "fr", "b", 4), (5, LONG, "en", "a", len(LONG)), (6, LONG + " end", "en", "b", 1),
            (1, "One fish. Two fish! Red fish?", "en", "a", 29), (7, "One fish. Two fish! Red fish?", "en", None, 29),
            (None, "no id here", "en", "a", 10), (None, None, "en", "a", None), (8, "été \U0001f642 世界", None, "z", 3),
            (9, "123 456 ... !!!", "de", "a", 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)

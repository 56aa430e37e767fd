import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label long, size long, bucket long, token long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, source]) rows, with extra columns whose names the operators use inside."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, 2, 3, 4) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    return make((1, "the same text of a few words here", "a"), (2, "the same text of a few words here", "b"), (2, "the same text of a few words here", "b"), (None, "a text without a number", None), (None, None, None), (3, "", "a"), (4, None, "b"), (5, long, "a"), (6, long + " end", "a"), (7, "été ГОРОД 東京 ñ!", "c"), (8, " \n\t ", "c"), (9, "!!! ???", "c"))


@pytest.fixture(scope="session")
def none(make, spark):
    return spark.createDataFrame([], DOCS)

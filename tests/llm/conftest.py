import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents from texts, with columns whose names clash with those that operators use."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", 0, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make

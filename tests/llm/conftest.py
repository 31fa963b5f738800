import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, __rank string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents with further columns whose names clash with what operators make."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOCS)

    return make

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, score double, copy int, kept string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns that share names with what operators compute."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), "w", 0.5, 9, "k") for i, t, lang, source in rows], DOCS)

    return make

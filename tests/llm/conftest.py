import pytest


@pytest.fixture(scope="session")
def doc_table(spark):
    """Makes a documents table with a column whose name clashes with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, h string")

    return make

import pytest


@pytest.fixture()
def docs(spark):
    """Documents (doc_id, text) with a column whose name operators might use, from rows."""

    def make(rows):
        return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, body string, digest int")

    return make


#: Nulls, empties, blanks, a repeated row, a repeated id, a long text and non-ASCII ones.
ODD = [(None, None), (None, "only text"), (1, ""), (2, None), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (5, "a b c d"), (5, "other words here"), (6, "é日本 😀 ñ"), (7, "word " * 30_000), (8, "abc")]


@pytest.fixture()
def odd(docs):
    return docs(ODD)

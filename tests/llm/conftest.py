import pytest


@pytest.fixture()
def docs(spark):
    """Makes a table of documents from (doc_id, text) pairs, with a column whose name clashes."""

    def make(*rows, source="s"):
        return spark.createDataFrame([(i, t, "en", source, len(t or ""), "kept") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")

    return make


#: Nulls, empty and blank texts, ties, repeated rows, a long text.
EDGES = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (None, "a b c d e f"), (None, None), (6, "w " * 30_000), (7, "A B C D E F"), (8, "é à ü")]

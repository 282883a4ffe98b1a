import pytest

EXTRA = "lang string, source string, n_chars long, score double, pos long, key string, line string, component string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", len(t or ""), 0.5, 1, "k", "l", "c") for i, t in rows], f"doc_id long, text string, {EXTRA}")

    return make


EDGE_ROWS = [(1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (5, "word " * 40_000), (6, "x" * 100_000), (7, "same line here\nsame line here"), (7, "same line here\nsame line here"), (None, "no id at all"), (8, "naïve ▁ 漢字 🙂\r\nend")]


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs(EDGE_ROWS)

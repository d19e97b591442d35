import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, line string, hash long, uid long"


@pytest.fixture
def docs(spark):
    """Makes a documents table with extra columns of clashing names from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"src{i % 3}", len(r[1] or ""), "x", 1, 2) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOC)

    return make


LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
#: Nulls, empty and blank texts, a very long one, repeated rows, a null id, equal ids.
ODD = [(1, None), (2, ""), (3, "   "), (4, LONG), (5, "same text here for all of us"), (5, "same text here for all of us"), (None, "text without an id but with words"), (7, "one"), (8, "line one\n\nline two \U0001f600 café"), (8, "another text of the same id")]

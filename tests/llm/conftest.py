from __future__ import annotations

import pytest

LONG = "Ünder the löng road of words we go again and again. " * 4000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, a repeated row, and columns whose names operators use inside."""
    names = ["n_words", "tag", "key", "line", "words", "print", "label", "rank", "hash", "parts"]
    rows = [(1, None), (None, "no id here at all"), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two three"), (5, "one two three"), (None, None), (6, "mail a@b.co, call +1 (555) 010-2030 again 5550102030")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, t, None if k % 2 else "en", None, None, *["x"] * len(names)) for k, (i, t) in enumerate(rows)], schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)

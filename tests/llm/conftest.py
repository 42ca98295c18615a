import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, n int, kept string, component string, digest string, `a b` int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """docs(texts or (doc_id, text) pairs, ...) with further columns whose names clash with the operators' own."""

    def make(*rows, lang="en", source="s"):
        full = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(*r, *(lang, source)[len(r) - 2 :]) for r in full]
        return spark.createDataFrame([(d, t, l, s, len(t or ""), 1, 2, "k", "c", "d", 3) for d, t, l, s in full], DOCS)

    return make


@pytest.fixture(scope="session")
def odd():
    """(doc_id, text): nulls in either column, empty and blank texts, a long text, a very long word, repeated rows and ids."""
    long_text = " ".join(f"w{i % 977} x{i % 31}" for i in range(15_000))
    return [(1, None), (2, ""), (3, " \t\n\x0b "), (4, long_text), (5, "z" * 50_000), (6, "one two"), (6, "one two"), (7, "one two"), (None, "one two three"), (None, "one two three"), (8, "solo"), (8, "other words here")]

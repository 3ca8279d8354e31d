import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, text_hash string, bucket int, uid string, __id int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the deep dark forest today"
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " again", "en", None), (4, None, None, "b"), (5, "", "en", "b"),
        (6, long, "en", "a"), (7, long + " tail", None, "c"), (None, "a text without an id that is long enough to count as one", "en", "a"),
        (None, None, None, None), (8, "!!! ??? ...", "en", ""), (9, "Short one.", "en", "c"), (10, "  spaces  \n\n and lines \n", "fr", "c"),
        (11, "Émile était là\nencore <|endoftext|> ici", "fr", "é"), (9, "Same id, other text.", "en", "c"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), "x", "y", 1, "z", 2) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

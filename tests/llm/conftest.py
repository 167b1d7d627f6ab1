import pytest

LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "Same words in this text again and again for all.", "en", "a", 48),
        (2, "Same words in this text again and again for all.", "en", "a", 48),
        (2, "Same words in this text again and again for all.", "en", "a", 48),
        (3, "", "en", None, 0),
        (4, None, None, "b", None),
        (None, "A row without an id, with a mail a.b@c.example.org in it.", "en", None, 5),
        (5, " \n\t ", None, "b", 4),
        (6, LONG, "en", "b", len(LONG)),
        (7, "x" * 20_000, "de", "b", 20_000),
        (8, "Ünïcödé 中文 😀 <|endoftext|> text\u0085 with \u2028 odd spaces", "de", "b", 40),
        (9, "tie tie", "de", "b", 7),
        (10, "tie tie", "fr", "b", 7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _copy_id string, _bad_id int, _key string, _terms string, fp string, rep int, ids string, u string"
    return spark.createDataFrame([(*r, "c", 1, "k", "t", "f", 3, "i", "u") for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

import pytest

DOC_SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
              "size string, fp string, kept string, __id string, score string, digest string, spot string, n string")


def make_docs(spark, rows):
    """Documents of (doc_id, text, lang, source) with extra columns whose names clash with inner ones."""
    full = [(*r, len(r[1] or ""), "x", "y", "z", "w", "s", "d", "p", "n") for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


LONG = "lorem ipsum dolor " * 20_000

ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "The quick  brown fox\njumps over the lazy dog", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, LONG, "en", "b"),
    (6, " \t\n", "de", None),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "c"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "c"),
    (None, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (8, "12345 !!! ###", "fr", "b"),
    (9, "Licensed under the MIT license. 你好 🙂 <|endoftext|>x", None, "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return make_docs(spark, ODD_ROWS).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])

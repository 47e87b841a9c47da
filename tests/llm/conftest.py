import pytest

#: Texts with the awkward cases: null, empty, blanks, ties, repeats, letters beyond ASCII, very long.
WORDS = "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions near old castle walls".split()


def long_text(n: int = 30_000) -> str:
    return " ".join(WORDS[(i * 7 + i // 11) % len(WORDS)] + str(i % 97) for i in range(n))


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, label string, `rank` int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls in every column, repeated rows, ties and columns whose names clash with the operators'."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. It was a fine day!", "en", "a", 5, 1, "x", 1),
        (2, "Der schnelle braune Fuchs springt über den faulen Hund und läuft.", "de", "b", 5, 1, "x", 1),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, 1, "x", 1),
        (5, "   \n\t ", "en", "a", 6, 1, "x", 1),
        (6, "12345 !!! 67", "en", "b", 12, 1, "x", 1),
        (7, "The quick brown fox jumps over the lazy dog. It was a fine day!", "en", "c", 5, 1, "x", 1),
        (7, "The quick brown fox jumps over the lazy dog. It was a fine day!", "en", "c", 5, 1, "x", 1),
        (None, "Call +1 (555) 010-9999 or mail jane@mail.example.com now", "en", "a", 5, 1, "x", 1),
        (8, "漢字🙂 don't  stop é́ <|endoftext|>", "en", "a", 5, 1, "x", 1),
        (9, long_text(), "en", "hot", 5, 1, "x", 1),
        (10, long_text() + " end", "en", "hot", 5, 1, "x", 1),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns."""
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    long = " ".join(words[i * i % 6] + str(i % 97) for i in range(60_000))
    rows = [
        (1, "plain text with some words here", "en", "s", 1, 1),
        (2, None, "en", None, None, 2),
        (3, "", None, "s", 0, 3),
        (4, " \n\t ", "de", "s", 4, 4),
        (5, long, "en", "s", 9, 5),
        (6, long + " tail", "en", "s", 9, 6),
        (None, "a text without an id", "en", "s", 3, 7),
        (7, "repeated row of a few words", "en", "s", 1, 8),
        (7, "repeated row of a few words", "en", "s", 1, 8),
        (8, "12345 !!! \x00 � é ß Ω 語", "fr", "s", 1, 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long")

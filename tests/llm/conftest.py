import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and an extra column with a clashing name."""
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door of the old house", "en", "s", 10, 0),
        (1, "the cat sat on the mat and the dog lay by the door of the old house", "en", "s", 10, 0),
        (2, "", "en", "s", 0, 1),
        (3, None, None, None, None, None),
        (None, "no id here but words enough to be looked at", "en", "s", 5, 2),
        (4, "word " * 30_000, "en", None, 150_000, 3),
        (5, "ein Hund und eine Katze sind im Haus\n\nund  noch\tmehr \x1c é̄ 漢字 😀 <|endoftext|>", "de", "s", 60, 4),
        (6, "   \n\t ", "en", "s", 6, 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

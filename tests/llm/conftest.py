import pytest

#: doc_id, text, lang, source, n_chars, and columns that clash with names of results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, kept int, sequence_id string, component_id string, host string"
LONG = "The long text goes on and on, word after word, line after line.\n" * 3000
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 60),
    (2, None, "en", "a", 0),
    (3, "", "fr", None, 0),
    (4, "   \n\t ", "de", "b", 5),
    (5, LONG, "en", None, len(LONG)),
    (6, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 60),
    (6, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 60),
    (7, "éàü ß 東京 \U0001f600 $$$ 12345", None, "c", 20),
    (None, "A row without an id stands here as well, with words enough to count.", "en", "b", 60),
    (8, "12345 !!! 67890 ###", "en", "b", 20),
    (9, "a", "es", "\U0001f600", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "x", 1, "y", "z", "h") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

import pytest

LONG = "river stone " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot string, gone string, h string, y string, group_id string, block string, band string, _text string, places string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named as the operators' own."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
        (3, None, "en", "a"),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", "a"),
        (6, LONG, "en", "a"),
        (7, "x" * 1_000_000, "en", "b"),
        (None, "a text without an id that says something of its own", "en", "a"),
        (8, "null language and source here, with enough words to count", None, None),
        (9, "emoji 😀 and ünïcödé ŵörds, twice 😀", "de", "b"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *["c"] * 10) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

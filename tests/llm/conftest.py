import pytest

LONG = "word " * 30_000 + "end."


@pytest.fixture(scope="module")
def small(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon for a long while.\nAnother line that says something else here.", "a", "x", 1),
        (2, "The cat sat on the mat and looked at the moon for a long while.\nA second text has this line of its own, quite long.", "a", "x", 2),
        (3, None, "b", None, 3),
        (4, "", "b", "y", 4),
        (5, LONG, None, "y", 5),
        (6, "one two", "a", "y", 6),
        (6, "one two", "a", "y", 6),
        (None, "a text without an id that nobody can name but that has enough words", "a", "z", 7),
        (7, "The cat sat on the mat and looked at the moon for a long while!\nAnother line that says something else there.", "a", "x", 8),
    ]
    schema = "doc_id long, text string, source string, _key string, drop int"
    return spark.createDataFrame(rows, schema)

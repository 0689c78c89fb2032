"""Small documents with every awkward case, and table makers."""

from __future__ import annotations

LONG = "wort " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, a very long text, characters outside the basic plane.
AWKWARD = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a", 1),
    (2, "the cat sat on  the mat\nand looked at the dog", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 0),
    (6, "the cat sat on the mat and looked at the dog", "en", "c", 1),
    (6, "the cat sat on the mat and looked at the dog", "en", "c", 1),
    (None, "the cat sat on the mat and looked at the dog", "en", "c", 1),
    (7, LONG, "de", "d", 1),
    (8, "x", "en", "d", 1),
    (9, "12 345 \U0001f600 é中ﬁ\x00 ▁▁ <s>", "en", "d", 1),
    (10, "Der Hund läuft schnell über die große Straße und die Katze schläft", "de", "d", 1),
    (11, "un deux trois quatre cinq six", "fr", "d", 1),
]


def table(spark, rows=AWKWARD, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(spark, names: list[str]):
    """The awkward documents with further columns of names that an operator uses itself."""
    from pyspark.sql import functions as F

    return table(spark).withColumns({n: F.lit("clash") for n in names})


def empty(spark):
    return table(spark, [])


def rows(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)

"""Awkward rows that every text operator must take."""

LONG = "wort " * 40_000

ROWS = [
    (1, "One two three four five six seven eight nine ten eleven."),
    (2, "One two three four five six seven eight nine ten eleven."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "word"),
    (7, LONG),
    (8, "x" * 50_000),
    (9, "Ünïcödé ﬁ é 😀 a@b.example.com 1.2.3.4 +1 (212) 555-0100 und so"),
    (10, "It's <|endoftext|> don't ▁literal ▁▁ end  two  spaces \x1c sep \x00 nul"),
    (11, "A B\nA B\nA B\n\nA B"),
    (2, "One two three four five six seven eight nine ten eleven."),
    (None, "a row without an id but with words in it"),
]
SCHEMA = "doc_id bigint, text string, fingerprint int, score string, kept string"


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeats, and columns named like results."""
    return spark.createDataFrame([(*r, 1, "s", "k") for r in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

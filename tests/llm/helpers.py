"""Fixtures of awkward rows, and plain restatements that the operators are compared with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"wört{i % 977} tail{i * 7 % 1009}," for i in range(9000))
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \n\t ", None, "a"),
    (4, "Same Text here, ÀÉ with İ and ẞ", "en", "a"),
    (5, "same text HERE, ÀÉ with İ and ẞ", "en", "a"),
    (5, "same text HERE, ÀÉ with İ and ẞ", "en", "a"),
    (6, "same text here, àé with i̇ and ß", "en", "b"),
    (7, LONG, "de", "b"),
    (8, LONG, "de", "b"),
    (9, "x" * 40_000, "de", "b"),
    (10, "one line\none line\n \none line two\n\x0b\none line", "en", "a"),
    (11, "a b c d e a b c d e f g a b c d e", "en", "a"),
    (12, "the the the the the the the the the the the the", "en", "a"),
    (13, "漢字 かな　テスト 'll it's ١٢٣ ½ \U0001f600 ՘x <|endoftext|>  \r\n\n end ", None, None),
    (None, "no id at all", "en", "a"),
    (14, "mail bob.smith@example.org, or +1-555-010-9999 now; ann@x.io's  \n", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, digest string, k int"


def fixture(spark, rows=ROWS):
    """With columns that operators use by the same names for themselves."""
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def collected(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)

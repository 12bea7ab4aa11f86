import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal texts, extra columns with clashing names."""
    base = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, base.replace("word7 ", "other "), "en", None, None), (4, "", "en", "b", 0), (5, None, None, None, None),
        (6, "one", "en", "b", 3), (7, "two words", "en", "b", 9), (8, "x " * 30_000, "de", "c", 60_000), (9, " \t\n ", "en", "b", 4), (10, "Ünï 日本 語　x\x1cy  z", "xx", "é", 9),
        (11, "unique text of some length that nobody else has written before today or ever will again", "en", "a", 8), (11, "unique text of some length that nobody else has written before today or ever will again", "en", "a", 8),
        (None, "a row without an id", "en", "a", 3), (12, "<|endoftext|> don't", "en", "a", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as `first`", "1 as size", "2 as shard", "3 as block")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

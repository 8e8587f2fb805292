"""Small tables, and plain Python versions of what the operators compute."""

import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def smallest_reached(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, "one two three", "en", "b"),
    (4, "one two three", "en", "b"),
    (None, "one two three", "en", "b"),
    (5, "word " * 30_000, "fr", "b"),
    (6, "ONE two\nthree Ünïcode space 漢字 \U0001f600", "de", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named as operators name theirs."""
    rows = [(*r, None, 7, "x") for r in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size long, score string"
    )

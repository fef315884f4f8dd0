"""A small table of awkward documents, with columns that clash with results."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, row string, id int, label int, number int, hash string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, **more):
        full = [(i, t, *(more.get("lang", ["en"] * len(rows))[n],), "src", None, "s", "r", 1, 2, 3, "h") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


AWKWARD = [
    (1, "The cat sat on the mat and that is it."),
    (None, None),
    (None, "a text without an id"),
    (2, ""),
    (2, ""),
    (3, None),
    (4, " \t\r\n"),
    (5, "x" * 50_000),
    (6, "word and " * 20_000),
    (7, "A b"),
    (7, "A b"),
    (8, "!!! 123 ???"),
    (9, "日本語 текст ελληνικά 😀   \x00 é"),
]


@pytest.fixture(scope="session")
def awkward(make_docs):
    return make_docs(AWKWARD)


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (99, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

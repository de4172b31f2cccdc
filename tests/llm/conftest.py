from __future__ import annotations

import pytest

from claimspark.llm.shipping import ship

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, rank int, size bigint, "
    "label string, row bigint, length bigint, digest string, place int, band int, word string"
)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 1, 2, 3, "x", 4, 5, "d", 6, 7, "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


ODD = [
    (1, "one two three four five six seven"),
    (1, "one two three four five six seven"),  # a repeated row
    (2, "one  two three four five\tsix seven "),  # equal but for blanks, longer
    (3, None),
    (4, ""),
    (5, " \n\t"),
    (None, "a row without an id"),
    (6, "ünïcode wörter 漢字 🎉 and + @ signs"),
    (7, "long text " * 30_000),
    (8, "x" * 200_000),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

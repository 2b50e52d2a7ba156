from __future__ import annotations

import pytest
from corpus_helpers import SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "one two three four five six seven eight", "en"), (1, "one two three four five six seven eight", "en"), (2, None, None), (3, "", "en"),
        (None, "one two three four five six seven eight", "de"), (4, " \n\t ", "fr"), (5, "word " * 30_000, "en"), (6, "é漢字😀 ’s I'll don't  x́\r\n", "es"), (7, "a", None),
    ]
    return spark.createDataFrame([(*r, "h", "t", 9, "score") for r in rows], "doc_id long, text string, lang string, h string, t string, n_bytes int, start string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp1 string, class string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, a repeated row, and extra columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer today"
    rows = [
        (1, prose, "en", "a", 1, "x", "y", "z"), (2, prose.upper(), "en", "a", 1, None, None, None), (3, prose.replace(" ", "  "), "en", "b", 1, None, None, None), (3, prose.replace(" ", "  "), "en", "b", 1, None, None, None),
        (4, None, "en", None, None, None, None, None), (5, "", None, "b", 0, None, None, None), (6, " \t\n", None, "b", 3, None, None, None), (None, prose, None, None, None, None, None, None),
        (7, "two words", "en", "c", 9, None, None, None), (8, "two words", "fr", "c", 9, None, None, None), (9, "1234 5678", "en", "c", 9, None, None, None), (10, prose + " and more", "en", "c", 1, None, None, None),
        (11, "long " * 40000 + "text", "en", "d", 1, None, None, None), (12, "long " * 40000 + "text", "en", "d", 1, None, None, None), (13, "éàü ñ ß", "fr", "d", 7, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

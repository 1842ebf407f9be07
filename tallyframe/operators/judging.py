"""Judgements by a pluggable callable over rows, with repair rounds; failures stay as rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import repaired

#: A judge takes (prompt, note on what was wrong before or None) and returns text that should be JSON.
Judge = Callable[[str, str | None], str]


def judged(rows: DataFrame, key: str, prompt: str, judge: Judge, check: Callable[[str], str | None] | None = None, tries: int = 3) -> DataFrame:
    """(key, status, answer, attempts): each row's prompt until the answer parses and passes the check.

    The next attempt is told what failed. A row whose attempts all fail is a row with status
    'failed', never a failed job; a share of failures is the caller's to limit.
    """

    def one(text):
        note = None
        for attempt in range(1, tries + 1):
            try:
                answer = repaired(judge(text, note))
                note = "not JSON" if answer is None else check(answer) if check else None
            except Exception as e:  # a judge may fail in any way; the row records it
                answer, note = None, f"{type(e).__name__}: {e}"
            if note is None:
                return "ok", answer, attempt
        return "failed", note, tries

    def batch(frames):
        for pdf in frames:
            out = [one(x) for x in pdf[prompt]]
            yield pd.DataFrame({key: pdf[key], "status": [o[0] for o in out], "answer": [o[1] for o in out], "attempts": [o[2] for o in out]})

    types = dict(rows.dtypes)
    return rows.select(key, prompt).mapInPandas(batch, f"{key} {types[key]}, status string, answer string, attempts int")


def cached(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(answers already in the cache, rows still to judge), by a content key."""
    return cache.join(rows.select(key).distinct(), key, "left_semi"), rows.join(cache.select(F.col(key)).distinct(), key, "left_anti")

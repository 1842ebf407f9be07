"""Query catalogue: name -> Spark query, and name -> DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collecting, performance, publishing, texts, timeline

_PARTS = (performance, texts, timeline, publishing, collecting)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.SQL.items()}

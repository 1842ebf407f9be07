"""Folds over sorted groups: rows of a group stream past a small state, however many they are."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], Iterable[tuple]], end: Callable[[object], Iterable[tuple]], schema: str, sorted_rows: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """For each group, in order: step(state, row) for its rows, then end(state); what they give are the
    result's rows. Groups are dealt out by key and sorted by Spark, so a task holds a batch and a state. sorted_rows adds, row by row, what the sort need not carry.

    Nulls in keys form groups of their own, first in order as Spark sorts them; no rows give none.
    """

    def run(batches):
        now, state, out = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                key = tuple(None if pd.isna(x) else x for x in row[: len(keys)])
                if key != now:
                    if now is not None:
                        out += end(state)
                    now, state = key, start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)
            out = []
        if now is not None:
            yield pd.DataFrame(list(end(state)), columns=names)

    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    first = rows.select(*keys, *(c for c in rows.columns if c not in keys))
    return sorted_rows(first.repartition(*keys).sortWithinPartitions(*keys, *order)).mapInPandas(run, schema)


def cut_islands(rows: DataFrame, by: str, at: Column, gap: float, name: str = "island") -> DataFrame:
    """rows with an island number: rows of a group that lie in the same run of time cells of width `gap`.

    Rows of different islands are more than `gap` apart. Only the occupied cells are numbered, by a
    window over distinct (group, cell); the rows are joined back, so a long group is spread. Rows with
    a null time, or a null group, are in an island of their own, 0."""
    cells = rows.withColumn("_cell", F.floor(at / gap))
    w = Window.partitionBy("c_by").orderBy("c_cell")
    some = cells.where(F.col(by).isNotNull() & F.col("_cell").isNotNull()).select(F.col(by).alias("c_by"), F.col("_cell").alias("c_cell")).distinct()
    new = F.when(F.col("c_cell") - F.coalesce(F.lag("c_cell").over(w), F.lit(-(1 << 62))) > 1, 1).otherwise(0)
    numbered = some.withColumn("_new", new).select("c_by", "c_cell", F.sum("_new").over(w).alias(name))
    j = cells.join(numbered, (F.col(by) == F.col("c_by")) & (F.col("_cell") == F.col("c_cell")), "left")
    return j.select(*rows.columns, F.coalesce(name, F.lit(0)).alias(name))

"""Exact order statistics of groups of any size: ranks from a range sort, so no group is held in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import stored


def ranked(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """rows with rank (from 0, by x within the group) and n (rows of the group with an x).

    Rows are sorted by ranges over all tasks and stored; a group that spans several tasks gets each
    task's first rank from the counts of the tasks before it. Null x: left out. Null groups are groups.
    Equal values share no rank: their order is arbitrary.
    """
    some = rows.where(F.col(x).isNotNull())
    s = stored(some.repartitionByRange(*by, x).sortWithinPartitions(*by, x).withColumn("_at", F.monotonically_increasing_id()))
    s = s.withColumn("_part", F.shiftright("_at", 33))
    w = Window.partitionBy(*by)
    parts = s.groupBy(*by, "_part").agg(F.count("*").alias("_here"), F.min("_at").alias("_first"))
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_here").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_here").over(w)})
    p = parts.select(*(F.col(c).alias(f"p_{c}") for c in (*by, "_part")), "_first", "_before", "n")
    on = reduce(lambda a, b: a & b, (s[c].eqNullSafe(p[f"p_{c}"]) for c in (*by, "_part")))
    return s.join(p, on).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "n")


def quantiles(rows: DataFrame, by: list[str], x: str, at: list[float]) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles with linear interpolation between neighbours, as percentile has them.
    A group without values has no row."""
    r = ranked(rows.select(*by, F.col(x).cast("double").alias("x")), by, "x")
    place = [F.lit(q) * (F.col("n") - 1) for q in at]
    wanted = reduce(lambda a, b: a | b, (F.col("rank").isin(F.floor(p), F.ceil(p)) for p in place))
    ends = [f(F.when(F.col("rank") == g(p), F.col("x"))).alias(f"_{k}{i}") for i, p in enumerate(place) for k, f, g in (("l", F.max, F.floor), ("h", F.max, F.ceil))]
    g = r.where(wanted).groupBy(*by).agg(F.max("n").alias("n"), *ends)

    def between(i: int):
        p, low, high = place[i], F.col(f"_l{i}"), F.col(f"_h{i}")
        return F.when((F.floor(p) == F.ceil(p)) | (low == high), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return g.select(*by, *(between(i).alias(f"q{i}") for i in range(len(at))))


def upper_medians(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, median): the value at place n // 2 of each sorted group."""
    r = ranked(rows.select(*by, x), by, x)
    return r.where(F.col("rank") == F.floor(F.col("n") / 2)).select(*by, F.col(x).alias("median"))


def median_deviations(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, median, mad): the median and the median of the distances to it."""
    m = stored(quantiles(rows, by, x, [0.5]).select(*(F.col(c).alias(f"m_{c}") for c in by), F.col("q0").alias("median")))
    on = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(m[f"m_{c}"]) for c in by))
    away = rows.join(m, on).select(*(rows[c] for c in by), F.abs(rows[x].cast("double") - F.col("median")).alias("away"))
    d = quantiles(away, by, "away", [0.5]).select(*by, F.col("q0").alias("mad"))
    on = reduce(lambda a, b: a & b, (d[c].eqNullSafe(m[f"m_{c}"]) for c in by))
    return d.join(m, on).select(*(d[c] for c in by), "median", "mad")

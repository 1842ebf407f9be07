"""Store operators: joins with defaults and accounting, newest rows, upserts and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, that of the largest order value (ties: the largest row); an aggregate that
    combines before its shuffle, so no key is sorted in one task."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col("_last")[c].alias(c) for c in rest)).select(*rows.columns)


def newest(rows: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    """The newest row of each group, ties by the largest tie value."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select(by, *(F.col("_r")[c].alias(c) for c in rest)).select(*rows.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Incoming rows replace those of equal keys; columns they lack, or hold null, keep their value."""
    last = keep_last(incoming, keys, order)
    own = [c for c in current.columns if c not in keys]
    a, b = current.alias("a"), last.alias("b")
    joined = a.join(b, reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), "full")
    value = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in last.columns else F.col(f"a.{c}").alias(c) for c in own]
    return joined.select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys), *value).select(*current.columns)


def left_with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join in which the right side's absent values become the defaults."""
    r = right.select(F.col(key).alias("_k"), *defaults)
    return left.join(r, F.col(key) == F.col("_k"), "left").drop("_k").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def fallback_join(left: DataFrame, overrides: DataFrame, first: str, second: str, guard: str, value: str) -> DataFrame:
    """left with `value` from overrides (key, guard, value) by the first key, else the second; an
    override whose guard is set and differs from the row's is discarded."""
    a = overrides.select(F.col("key").alias("_a"), F.struct(F.col(guard).alias("g"), F.col(value).alias("v")).alias("_av"))
    b = overrides.select(F.col("key").alias("_b"), F.struct(F.col(guard).alias("g"), F.col(value).alias("v")).alias("_bv"))
    joined = left.join(a, F.col(first).cast("string") == F.col("_a"), "left").join(b, F.col(second).cast("string") == F.col("_b"), "left")
    found = F.coalesce("_av", "_bv")
    ok = found["g"].isNull() | (found["g"] == F.col(guard))
    return joined.withColumn(value, F.when(ok, found["v"])).drop("_a", "_b", "_av", "_bv")


def target_or_last(rows: DataFrame, by: str, window: str, target: str) -> DataFrame:
    """Each group's rows of the target window, or where it has none those of its last window."""
    picked = rows.groupBy(F.col(by).alias("_by")).agg(F.coalesce(F.max(F.when(F.col(window) == target, F.col(window))), F.max(window)).alias("_w"))
    return rows.join(picked, (F.col(by) == F.col("_by")) & (F.col(window) == F.col("_w"))).drop("_by", "_w")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) for every table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in tables.items()))


def issues(*rules: tuple[Column, str, str]) -> Column:
    """Array of (code, severity) for the rules whose condition holds."""
    found = F.array(*(F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for cond, code, severity in rules))
    return F.filter(found, lambda x: x.isNotNull())


def flags(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(cond, F.lit(name)) for cond, name in rules)), lambda x: x.isNotNull())

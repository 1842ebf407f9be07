"""Shared pieces of the training-data operators: durable intermediates and the link graph's components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
_stored: list[str] = []
#: Whether shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at a time, and how many of whole texts: they lie in the JVM and in the worker, more than once in each.
BATCH_ROWS, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local master may fall back to a temporary folder; a cluster without the
    setting is an error, since its executors would not see each other's files.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyframe-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def clear(spark: SparkSession) -> None:
    """Deletes what this process has stored. Results that still read from it are to be written first."""
    for path in _stored:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _stored.clear()


def small_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """From now on in this session no more than so many rows go to a Python worker at a time; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back: lineage ends here,
    and a lost executor costs a reread, not a recomputation. The shuffle files of the plan go with it.
    With rows, Python workers get no more than so many at a time while it is written."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/tallyframe/{uuid.uuid4().hex}", {k: spark.conf.get(k, None) for k in (CLEANUP, BATCH_ROWS)}
    spark.conf.set(CLEANUP, "true")
    if rows:
        small_batches(spark, rows)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored DataFrame that nothing reads any more."""
    spark = df.sparkSession
    for path in {"/".join(f.split("/")[:-1]) for f in df.inputFiles()}:
        if path.split("/")[-2:-1] == ["tallyframe"]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: A key with more than one in HOT of all rows is joined by broadcast: there are fewer than HOT such keys.
HOT = 1024


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """rows, left joined with per_key: one row per key, n being the rows that it holds.

    Keys with many rows are joined by a broadcast of fewer than HOT rows (2 * HOT for a total that
    is a bound only), so their rows stay where they are; only the others are dealt out by key. Rows
    with a null key are not dealt out at all. Both sides are read more than once: store them first.
    """
    total = total if total is not None else per_key.agg(F.sum(n)).first()[0] or 0
    hot, cold = per_key.where(F.col(n) * HOT > total), per_key.where(F.col(n) * HOT <= total)
    some = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    spread = rows.where(some).join(F.broadcast(hot), keys)
    dealt = rows.where(some).join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, "left")
    absent = rows.where(~some).select(*rows.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in per_key.schema if f.name not in keys))
    return spread.unionByName(dealt).unionByName(absent)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (id, component_id) for every id on a link; component_id is the smallest id reachable.

    Alternating large-star and small-star steps: each shrinks the graph towards stars whose
    centre is the smallest id. A step is one grouped minimum (combined before the shuffle) and
    one join by id, by broadcast for the hubs. Every round's edges are stored.
    Empty input gives no rows; null ends and self links are ignored; repeated links count once.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, seen = stored(e), None
    for _ in range(rounds):
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark.n == 0 or (mark.n, mark.x) == seen:
            break
        seen = (mark.n, mark.x)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_by_key(both.where("v > u"), low, ["u"], "n", 2 * mark.n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_by_key(large, low, ["u"], "n", 2 * mark.n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return stars.union(stars.select(F.col("component_id").alias("id"), "component_id").distinct())

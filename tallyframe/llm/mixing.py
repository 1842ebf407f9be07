"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With weight w its i-th block (from 0) is released at floor(i / w)
and due by ceil((i + 1) / w); earliest deadline first then fills one slot after another, and every
source's share of any prefix stays within less than one block of its weight. Weights are exact
fractions, never rounded to parts of a period. A block holds BLOCK rows, or as many more as leave
about SLOTS blocks in all: the driver, which goes through the slots once with one entry a source,
does bounded work for any number of rows. The rows take their slots by a join. When a source runs
out, the others go on by their weights in a new phase, so every row is placed.

Defined cases: a null source is a source of its own; a null doc_id is kept; rows with equal ids are
told apart by a hash of the row's text; an empty table gives no rows; null text is allowed; other
columns are carried or ignored as the caller selects. Without weights, a source's is the square
root of its number of rows; a source without a positive weight has the least of the others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK, PARTS = 16, 1000
#: Rows in a bucket of a source, in which rows are ranked together.
BUCKET = 20_000
#: Blocks of all sources together, at most one more for each source; slots that the driver holds before it writes them.
SLOTS, CHUNK = 1_000_000, 250_000


def whole_weights(weights: dict[str, float], parts: int = PARTS) -> dict[str, int]:
    """Weights as whole parts, at least one each, by largest remainder."""
    total = sum(weights.values())
    parts = max(parts, 10 * len(weights))
    exact = {k: v / total * parts for k, v in weights.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    spare = parts - sum(out.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k)):
        if spare <= 0:
            break
        out[k] += 1
        spare -= 1
    return out


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """Positive weights, as the decimals they are written as, times a common denominator."""
    exact = {k: Fraction(w) if isinstance(w, int | Fraction) else Fraction(repr(float(w))) for k, w in weights.items()}
    common = math.lcm(*(w.denominator for w in exact.values()))
    return {k: int(w * common) for k, w in exact.items()}


def slots(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int]]:
    """The (source, block) of each slot: earliest deadline first among released blocks, by exact
    weights; equal deadlines go to the larger weight. A phase ends when a source has no block left.
    In a new phase the sources' first blocks are due in the order of their weights, so only those
    that a phase has served are held in its heaps, and a slot costs the logarithm of the sources."""
    names = sorted((k for k, n in blocks.items() if n > 0), key=lambda k: (-weights[k], k))
    w, left = [weights[k] for k in names], [blocks[k] for k in names]
    done, total = [0] * len(names), sum(w)
    after = list(range(1, len(names) + 1))  # the next source that is not known to have run out
    start = 0

    def alive(j: int) -> int:
        passed = []
        while j < len(names) and not left[j]:
            passed.append(j)
            j = after[j]
        for p in passed:
            after[p] = j
        return j

    while (start := alive(start)) < len(names):
        t, first, served = 0, start, {}
        coming: list[tuple[int, int, int]] = []  # release, deadline, source
        ready: list[tuple[int, int]] = []
        while True:
            while coming and coming[0][0] <= t:
                heapq.heappush(ready, heapq.heappop(coming)[1:])
            if first < len(names) and (not ready or (-(-total // w[first]), first) < ready[0]):
                j, first = first, alive(first + 1)
            else:
                j = heapq.heappop(ready)[1]
            yield names[j], done[j]
            t += 1
            done[j] += 1
            left[j] -= 1
            if not left[j]:
                total -= w[j]
                break
            i = served[j] = served.get(j, 0) + 1
            heapq.heappush(coming, (i * total // w[j], -(-(i + 1) * total // w[j]), j))


def period(parts: dict[str, int]) -> list[str]:
    """The sources of one period's slots, for weights that are whole parts of it."""
    return [k for k, _ in slots(parts, parts)]


def _plan(spark: SparkSession, blocks: dict[str, int], weights: dict[str, int]) -> DataFrame:
    """p_key, p_block, slot: a row per block, written in chunks."""
    schema, at, out = "p_key string, p_block long, slot long", 0, None
    order = slots(blocks, weights)
    while chunk := list(islice(order, CHUNK)):
        keys, nth = zip(*chunk, strict=True)
        table = pa.table({"p_key": pa.array(keys, pa.string()), "p_block": pa.array(nth, pa.int64()), "slot": pa.array(range(at, at + len(chunk)), pa.int64())})
        part = stored(spark.createDataFrame(table))
        out, at = part if out is None else out.union(part), at + len(chunk)
    return spark.createDataFrame([], schema) if out is None else out


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: int = 0, slots_wanted: int = SLOTS) -> DataFrame:
    """doc_id, text_hash, source, block, slot, offset, position: a row per document.

    Rows are ranked by hash within hashed buckets of their source, and buckets are shifted by the
    counts before them, so a source that holds most rows is ranked in many tasks. A count a source
    goes to the driver; the plan that comes back has a row per block, SLOTS of them and one a source
    at most, and is joined by source and block.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", key.alias("key"))
    counts = {r["key"]: r["n"] for r in rows.groupBy("key").agg(F.count("*").alias("n")).collect()}
    block = max(block, -(-sum(counts.values()) // slots_wanted))
    given = {k: (math.sqrt(n) if weights is None else weights.get(k[1:] if k[0] == "s" else None, 0)) for k, n in counts.items()}
    least = min((w for w in given.values() if w > 0), default=1)
    plan = _plan(spark, {k: -(-n // block) for k, n in counts.items()}, exact_weights({k: w if w > 0 else least for k, w in given.items()}))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // BUCKET)
    dealt = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod(F.xxhash64("order"), F.lit(buckets)))
    sizes = dealt.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("key").alias("b_key"), F.col("bucket").alias("b_bucket"), (F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "text_hash")) - 1
    ranked = dealt.withColumn("nth", nth).join(before, (F.col("key") == F.col("b_key")) & (F.col("bucket") == F.col("b_bucket")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth")).withColumn("block", F.floor(F.col("rank") / block)).withColumn("offset", F.col("rank") % block)
    placed = ranked.join(plan, (F.col("key") == F.col("p_key")) & (F.col("block") == F.col("p_block")))
    return placed.select("doc_id", "text_hash", "source", "block", "slot", "offset").withColumn("position", F.col("slot") * block + F.col("offset"))

"""Stateful streams against their batch counterparts, and what a replay changes."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import readers
from tallyframe.streaming import events, priors


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", priors.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drain(stream, name, folder, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_decayed_evidence_is_the_batchs(rocks, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.gauss(0, 1)]), float(rng.randrange(400))) for _ in range(300)]
    schema = "hook_type string, hqs double, day double"
    for i in range(3):  # arrives in three files, out of order
        rocks.createDataFrame(rows[i::3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    drain(priors.decayed_evidence(stream), "evidence", tmp_path, "update")
    got = {r.hook_type: (r.n, r.s) for r in priors.as_of(rocks.table("evidence"), 500.0).collect()}
    want = {}
    for h, x, day in rows:
        if h and x is not None:
            w = math.exp((day - 500) / priors.TAU)
            n, s = want.get(h, (0.0, 0.0))
            want[h] = n + w, s + w * x
    assert got.keys() == want.keys()
    assert all(got[h] == pytest.approx(want[h]) for h in want)


def test_a_replayed_overlap_is_dropped(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, value double"
    batch = lambda a, b: spark.createDataFrame([(i, 1_700_000_000 + i * 60, float(i)) for i in range(a, b)], "event_id bigint, ts long, value double").withColumn("ts", F.timestamp_seconds("ts"))
    for i, (a, b) in enumerate([(0, 10), (5, 15), (12, 20)]):
        batch(a, b).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    drain(events.once(stream, late="1 hour"), "replayed", tmp_path)
    assert sorted(r.event_id for r in spark.table("replayed").collect()) == list(range(20))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    schema = "video_id string, title string, at int"
    for i, rows in enumerate([[("a", "x", 1), ("b", "y", 1)], [("a", "z", 2), ("c", "w", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for run in ("one", "two"):  # another checkpoint: every batch again
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = events.upsert_sink(stream, f"{tmp_path}/videos", "videos", "at", f"{tmp_path}/{run}")
        q.processAllAvailable()
        q.stop()
        assert sorted((r.video_id, r.title) for r in readers.maybe_table(spark, f"{tmp_path}/videos", "videos").collect()) == [("a", "z"), ("b", "y"), ("c", "w")]

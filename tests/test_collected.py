"""The append-log source: blocks, pushed filters, bad lines; and who can be collected."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import collected, readers


@pytest.fixture
def logs(tmp_path):
    for platform, n in (("youtube", 200), ("x", 7)):
        with open(tmp_path / f"{platform}.jsonl", "w", encoding="utf-8") as file:
            for i in range(n):
                file.write(json.dumps({"post_id": f"p{i}", "window": f"w{i % 3}", "call": "core", "body": {"rows": [[i, "ş"]]}}, ensure_ascii=False) + "\n" + "\n" * (i % 5 == 0))
            file.write("{broken\n[1]\n")
    (tmp_path / "notes.txt").write_text("not a log")
    return str(tmp_path)


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_every_line_once(spark, logs, block):
    collected.register(spark)
    df = spark.read.format("append_logs").option("path", logs).option("block", block).load()
    rows = df.collect()
    assert sorted((r.platform, r.post_id) for r in rows if r.post_id) == sorted([("youtube", f"p{i}") for i in range(200)] + [("x", f"p{i}") for i in range(7)])
    assert sorted((r.platform, r._corrupt) for r in rows if r._corrupt) == [("x", "[1]"), ("x", "{broken"), ("youtube", "[1]"), ("youtube", "{broken")]
    assert df.where("post_id = 'p3' and platform = 'x'").select(F.get_json_object("body", "$.rows[0][1]")).first()[0] == "ş"


def test_filters_reach_the_source(spark, logs):
    collected.register(spark)
    df = spark.read.format("append_logs").option("path", logs).load().where("platform = 'x' and window in ('w1', 'w2') and post_id > 'p3'")
    assert sorted(r.post_id for r in df.collect()) == ["p4", "p5"]
    filters = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line]
    assert not any("platform" in x and "= x" in x.split("PushedFilters")[0] for x in filters)  # Spark does not test it again
    reader = collected.AppendLogReader(df.schema, logs, 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("platform",), "x"), GreaterThan(("post_id",), "p3")]))
    assert [type(x) for x in left] == [GreaterThan] and {b.platform for b in reader.partitions()} == {"x"}


def test_no_logs(spark, tmp_path):
    collected.register(spark)
    assert spark.read.format("append_logs").option("path", str(tmp_path)).load().count() == 0


def test_availability(spark):
    c = readers.collectors(spark, {"youtube": None, "x": "no key"})
    posts = spark.createDataFrame([(1, "youtube", "mine"), (2, "x", None), (3, "tiktok", None), (4, None, None)], "post_id int, platform string, reason_given string")
    assert [(r.post_id, r.collectable, r.reason) for r in collected.availability(posts, c).orderBy("post_id").collect()] == [(1, True, None), (2, False, "no key"), (3, False, "no collector for this platform"), (4, False, "no collector for this platform")]

"""Publish plans against a plain fold, and rounding and responses against Python's own."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.numbers import round_binary
from tallyframe.operators import collect, folds
from tallyframe.operators import schedule as sch

POSTS = "video string, clip string, post_id long, platform string, hook_type string, now timestamp_ntz"


def plain_plan(posts, slots, jitter):
    out, taken, clips = {}, {}, {}
    for video, clip, post, platform, _, _ in sorted(posts, key=lambda p: (p[0], p[2])):
        notes, pick = [], None
        for score, rule, at in slots[post]:
            if any(abs((at - t).total_seconds()) < 4 * 3600 for t in taken.get((video, platform), [])):
                continue
            if (at.month, at.day) in sch.HOLIDAYS:
                notes.append("G3_holiday_skipped")
                continue
            pick = (score, rule, at)
            break
        if pick is None:
            pick = slots[post][0]
            notes.append("G1_relaxed_no_free_slot")
        at = pick[2]
        if any(abs((at - t).total_seconds()) < 30 * 60 for t in clips.get((video, clip), [])):
            at += timedelta(minutes=30)
            notes.append("G2_cross_platform_stagger")
        at += timedelta(minutes=jitter[post])
        taken.setdefault((video, platform), []).append(at)
        clips.setdefault((video, clip), []).append(at)
        out[post] = (pick[1], at, ",".join([*notes, "G5_jitter_applied"]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_plans_equal_a_plain_fold(spark, seed):
    rnd = random.Random(seed)
    start = datetime(2024, 4, 18) if seed else datetime(2024, 12, 28)  # around holidays
    posts = [(f"v{rnd.randrange(2)}", f"c{rnd.randrange(4)}", i, rnd.choice(["linkedin", "x", "tiktok", "elsewhere"]), rnd.choice(["data_number", "howto", None]), start + timedelta(hours=rnd.randrange(72 if seed < 2 else 3000))) for i in range(60)]
    df = spark.createDataFrame(posts, POSTS).repartition(4)
    slots = {i: [] for i in range(60)}
    for r in sch.slot_candidates(df).orderBy(F.desc("score"), "day", "rule").collect():
        slots[r.post_id].append((r.score, r.rule, r.slot))
    jitter = {r.post_id: r.j for r in df.select("post_id", sch.jitter_minutes(F.col("post_id").cast("string")).alias("j")).collect()}
    got = {r.post_id: (r.rule, r.slot, r.constraints) for r in sch.plan_slots(df, "video", "clip").collect()}
    assert got == plain_plan(posts, slots, jitter)
    if seed == 1:
        assert all(any(note in x[2] for x in got.values()) for note in ("G1_", "G2_", "G3_"))


@pytest.mark.parametrize("start", [datetime(2024, 4, 15), datetime(2024, 6, 3)])  # with holidays in reach, and without
def test_crowded_plans_equal_a_plain_fold(spark, start):
    """Many more posts than slots, and clips whose posts stagger each other."""
    rnd = random.Random(7)
    posts = [(f"v{rnd.randrange(2)}", f"c{rnd.randrange(60)}", i, rnd.choice(["linkedin", "linkedin", "x", "instagram", "elsewhere"]), rnd.choice(["data_number", "contrarian", None]), start + timedelta(days=rnd.randrange(4), hours=rnd.choice([6, 7.5, 7.6, 12, 21]))) for i in range(1500)]
    df = spark.createDataFrame(posts, POSTS).repartition(4)
    slots = {i: [] for i in range(len(posts))}
    for r in sch.slot_candidates(df).orderBy(F.desc("score"), "day", "rule").collect():
        slots[r.post_id].append((r.score, r.rule, r.slot))
    jitter = {r.post_id: r.j for r in df.select("post_id", sch.jitter_minutes(F.col("post_id").cast("string")).alias("j")).collect()}
    got = {r.post_id: (r.rule, r.slot, r.constraints) for r in sch.plan_slots(df, "video", "clip").collect()}
    wanted = plain_plan(posts, slots, jitter)
    assert got == wanted
    assert any("G2_" in x[2] for x in wanted.values()) and any("G3_" in x[2] for x in wanted.values()) == (start.month == 4)


def test_posts_behind_all_slots_are_not_folded(spark, monkeypatch):
    """The first post for each slot finds one free at most; the others of the day are planned row by row."""
    sizes, plain = [], sch.folded
    monkeypatch.setattr(sch, "folded", lambda rows, *args: sizes.append(rows.count()) or plain(rows, *args))
    posts = [(f"v{i % 2}", f"c{i}", i, "instagram", "story", datetime(2024, 6, 3, 6)) for i in range(300)]
    plan = sch.plan_slots(spark.createDataFrame(posts, POSTS), "video", "clip")
    relaxed = plan.groupBy("video").agg(F.count_if(F.col("constraints").contains("G1_")).alias("n")).collect()
    assert sizes == [2 * 12, 0] and all(150 - 12 <= r.n < 150 for r in relaxed)  # seven days of S3, five of S4


def test_taken_minutes_are_near_as_a_list_tells():
    rnd = random.Random(2)
    for gap in (30, 240):
        taken, plain = sch.Taken(gap), []
        for _ in range(300):
            at = rnd.randrange(-50 * gap, 50 * gap)
            assert taken.near(at) == any(abs(at - t) < gap for t in plain)
            if rnd.random() < 0.3:
                taken.add(at)
                plain.append(at)


def test_posts_of_other_clips_keep_the_platforms_gap(spark):
    at = datetime(2024, 3, 4, 6)
    df = spark.createDataFrame([("v", "a", 1, "linkedin", "story", at), ("v", "b", 2, "linkedin", "story", at), ("w", "a", 3, "linkedin", "story", at)], POSTS)
    r = {x.post_id: x.slot for x in sch.plan_slots(df, "video", "clip").collect()}
    assert abs((r[1] - r[2]).total_seconds()) >= 4 * 3600 - 24 * 60  # jitter moves either by twelve minutes
    assert abs((r[1] - r[3]).total_seconds()) <= 24 * 60  # another video


def test_plans_of_odd_rows(spark):
    at = datetime(2024, 3, 4, 6)
    rows = [("v", "a", 1, None, "story", at), ("v", "a", 2, "x", None, None), (None, None, 3, "x", None, at), ("v", "a", 4, "x", "story", at), ("v", "a", 4, "x", "story", at)]
    got = sorted((x.post_id, x.rule, x.constraints) for x in sch.plan_slots(spark.createDataFrame(rows, POSTS), "video", "clip").collect())
    assert [x[:2] for x in got][:2] == [(1, "FALLBACK"), (2, "FALLBACK")] and got[0][2] == "no_rule_matched" and len(got) == 5
    assert sch.plan_slots(spark.createDataFrame([], POSTS), "video", "clip").count() == 0


def test_islands_are_apart_and_folds_stream(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *(float(rnd.randrange(300)) for _ in range(9))])) for _ in range(200)]
    df = folds.cut_islands(spark.createDataFrame(rows, "g string, t double"), "g", F.col("t"), 10.0)
    seen = {}
    for r in df.where("g is not null and t is not null").collect():
        seen.setdefault(r.g, {}).setdefault(r.island, []).append(r.t)
    for own in seen.values():
        spans = sorted((min(x), max(x)) for x in own.values())
        assert all(b[0] - a[1] > 10 for a, b in zip(spans, spans[1:], strict=False)) and len(spans) > 1
    assert df.count() == 200
    total = folds.folded(df.select("g", "island", "t"), ["g", "island"], ["t"], lambda: [0], lambda s, r: s.__setitem__(0, s[0] + 1) or (), lambda s: [(s[0],)], "n long")
    assert total.agg(F.sum("n")).first()[0] == 200


def test_rounding_is_pythons(spark):
    rnd = random.Random(1)
    xs = [2.675, 0.125, 0.375, 1.005, -2.675, 0.5, 1.5, 2.5, 0.0, 1e-9, 123456.785, 1e300, *(rnd.randrange(10**6) / 1000 for _ in range(500)), *(rnd.uniform(-10, 10) for _ in range(200)), *((2 * rnd.randrange(1000) + 1) / 16 for _ in range(100))]
    for digits in (0, 1, 2, 3, 5):
        got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(round_binary(F.col("x"), digits)).collect()]
        assert got == [round(x, digits) for x in xs]


def test_responses_merge_by_precedence(spark):
    heads = [{"name": n} for n in ("views", "averageViewPercentage", "likes")]
    rows = [
        ("p", "w1", "core", json.dumps({"columnHeaders": heads, "rows": [[100, 43.215, 7]]}), 30.0),
        ("p", "w1", "retention", json.dumps({"rows": [[1.0, 0.2], [0.0, 1.0], [0.2, 0.5]]}), 30.0),
        ("p", "w1", "lifetime", json.dumps({"items": [{"statistics": {"likeCount": "900", "commentCount": "11"}}]}), None),
        ("p", "w2", "core", json.dumps({"columnHeaders": heads, "rows": [[0, "x", 7]]}), 30.0),
        ("p", "w2", "retention", "{", 30.0),
        ("q", "w1", "core", json.dumps({"columnHeaders": heads, "rows": []}), 30.0),
        ("q", "w1", "retention", json.dumps({"rows": [[0.0, 1.0]]}), 0.0),
        ("q", "w1", "other", "{}", 1.0),
        ("r", "w1", "core", None, 1.0),
        ("s", "w1", "core", json.dumps({"columnHeaders": [*heads, {"name": "views"}, {"name": "shares"}], "rows": [[1, 2, 3, 4]]}), 1.0),
    ]
    got = {(r.post_id, r.window): r for r in collect.collected_share(collect.parse_responses(spark.createDataFrame(rows, "post_id string, window string, call string, body string, duration_s double"))).collect()}
    a = got["p", "w1"]
    assert (a.views, a.likes, a.comments, a.shares, a.completion_rate, a.engagement_rate) == (100, 7, 11, None, round(43.215 / 100, 4), 0.07)
    assert [(p.x, p.y) for p in a.retention_curve] == [(30.0, 0.2), (0.0, 1.0), (6.0, 0.5)] and (a.hook_retention_3s, a.dropoff_3s, a.errors) == (0.75, 0.25, [])
    b = got["p", "w2"]
    assert b.views is None and b.likes is None and b.errors == ["core: not a number", "retention: not JSON"] and b.provenance == "SIMULATED"
    assert got["q", "w1"].errors == [] and got["q", "w1"].n_measured == 0
    assert got["r", "w1"].errors == ["core: not JSON"]
    assert got["s", "w1"].views == 4 and got["s", "w1"].shares is None


def test_slots_are_not_sorted(spark):
    """A video is one sort: posts are sorted bare, their slots are worked out behind it."""
    plan = sch.plan_slots(spark.createDataFrame([], POSTS), "video", "clip")._jdf.queryExecution().optimizedPlan().toString()
    sort = next(i for i, line in enumerate(plan.splitlines()) if "Sort [video" in line)
    shuffled = next(line for line in plan.splitlines()[sort:] if "Project [video" in line)
    assert "slots" not in shuffled


def test_answers_are_read_once(spark):
    from tallyframe.plans import collecting

    plan = collecting.metric_responses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == plan.count("Relation [") == 1

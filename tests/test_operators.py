"""Operators on small literal inputs and against plain brute force."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import hashing, jsonx, urls
from tallyframe.functions import text as tx
from tallyframe.operators import performance as perf
from tallyframe.operators import priors, publish, schedule, segments, store, timeseries


def brute(intervals, k, gap):
    best = (0, 0.0)
    for n in range(k + 1):
        for c in itertools.combinations(intervals, n):
            c = sorted(c)
            if all(a[1] + gap <= b[0] for a, b in zip(c, c[1:])):
                best = max(best, (n, round(sum(x[2] for x in c), 6)))
    return best


@pytest.mark.parametrize("seed", range(20))
def test_best_intervals_is_optimal(seed):
    rng = random.Random(seed)
    rows = [(s := rng.uniform(0, 100), s + rng.uniform(1, 30), round(rng.uniform(1, 60), 2)) for _ in range(9)]
    start, end, score = map(list, zip(*rows))
    totals = schedule.best_by_count(start, end, score, 3, 5.0)
    assert (len(totals) - 1, round(totals[-1][0], 6)) == brute(rows, 3, 5.0)
    assert all(round(sum(score[i] for i in chosen), 6) == round(total, 6) and len(chosen) == c for c, (total, chosen) in enumerate(totals))


@pytest.mark.parametrize(("rows", "k", "gap", "scores"), [
    ([(125, 146, 43.0), (152, 173, 38.3), (125, 173, 62.9)], 1, 5, [62.9]),
    ([(0, 100, 50), (0, 40, 30), (50, 90, 30)], 2, 5, [30, 30]),
    ([(0, 10, 50), (12, 20, 50)], 2, 5, [50]),
    ([(0, 10, 50)], 3, 5, [50]), ([(0, 10, 5)], 0, 5, []),
])
def test_interval_cases(rows, k, gap, scores):
    s, e, v = map(list, zip(*rows))
    assert [v[i] for i in schedule.best_by_count(s, e, v, k, gap)[-1][1]] == scores


def test_exploration_reserves_a_slot(spark):
    rows = spark.createDataFrame([("v", i, 20.0 * i, 20.0 * i + 10, x, k) for i, (x, k) in enumerate([(50.0, "howto"), (40.0, "howto"), (30.0, "howto"), (5.0, "story")])], "v string, id int, start double, end double, score double, kind string")
    chosen = lambda **more: sorted(r.id for r in schedule.schedule(rows, "v", "id", 3, 5.0, **more).collect())
    assert chosen() == chosen(kind="kind", exploited=frozenset()) == [0, 1, 2]
    assert chosen(kind="kind", exploited=frozenset({"howto"})) == [0, 1, 3]


@pytest.mark.parametrize("seed", range(4))
def test_schedule_is_the_best_of_all(spark, seed, monkeypatch):
    monkeypatch.setattr(schedule, "BLOCK", 2)
    rng = random.Random(seed)
    data = []
    for g in ("a", "b", None, "c"):
        for i in range(rng.randrange(1, 12)):
            s = round(rng.uniform(0, 300 if g == "a" else 60), 3)
            data.append((g, len(data), s, round(s + rng.uniform(1, 20), 3), round(rng.uniform(1, 60), 2), rng.choice(["x", "y"]), "other"))
    data += [("d", 1000, None, 1.0, 1.0, "x", "z"), ("d", 1001, 0.0, 1.0, None, "x", "z"), ("d", 1002, 0.0, 1.0, 9.0, None, "z")]
    df = spark.createDataFrame(data, "g string, id long, start double, end double, score double, kind string, k string")
    got = {}
    for r in schedule.schedule(df, "g", "id", 3, 5.0).collect():
        got.setdefault(r.g, []).append((r.start, r.end, r.score))
    for g in ("a", "b", None, "c"):
        rows = [(x[2], x[3], x[4]) for x in data if x[0] == g]
        assert (len(got[g]), round(sum(x[2] for x in got[g]), 6)) == brute(rows, 3, 5.0)
    assert got["d"] == [(0.0, 1.0, 9.0)]
    levels = {}
    for r in schedule.schedule(df, "g", "id", 3, 5.0, thresholds=(45.0, 30.0)).collect():
        levels.setdefault(r.g, []).append((r.threshold, r.score))
    for g in ("a", "b", None, "c"):
        for low in (45.0, 30.0):
            want = brute([(x[2], x[3], x[4]) for x in data if x[0] == g and x[4] >= low], 3, 5.0)
            if want[0] == 3 or low == 30.0:
                assert (len(levels.get(g, [])), round(sum(x[1] for x in levels.get(g, [])), 6)) == want and {x[0] for x in levels.get(g, [])} <= {low}
                break


def test_zscore_of_lone_and_flat_groups(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.1), ("c", 1.0), ("c", 3.0)], "platform string, ctr double")
    z = sorted(r.z_ctr for r in perf.zscores(rows, metrics=("ctr",)).collect())
    assert z == pytest.approx([-0.7071067811865475, 0, 0, 0, 0.7071067811865475])


def test_ab_needs_agreement_and_size(spark):
    def rows(group, pairs):
        return [(group, p, v, x, 0.5, 0.05, 0.01) for p, a, b in pairs for v, x in (("A", a), ("B", b))]

    data = rows("big", [("ig", 0.7, 1.0)]) + rows("small", [("ig", 0.7, 0.701)]) + rows("split", [("ig", 0.62, 0.40), ("tt", 0.60, 0.90), ("yt", 0.61, 0.95)]) + rows("one", [("ig", 0.7, 0.8)])[:1] + rows("zero", [("ig", 0.0, 0.8)])
    df = spark.createDataFrame(data, "ab_group string, platform string, variant string, hook_retention_3s double, completion_rate double, engagement_rate double, ctr double")
    got = {r.ab_group: r for r in perf.ab_verdicts(perf.ab_lifts(df)).collect()}
    assert got["big"].winner == "B" and got["small"].winner is None and not got["small"].material
    assert got["split"].winner is None and "one" not in got and got["zero"].mean_lift == 0


def test_priors_are_neutral_without_evidence_and_bounded(spark):
    types = spark.createDataFrame([("a",), ("b",), ("c",)], "hook_type string")
    none = spark.createDataFrame([], "hook_type string, hqs double, age_days double")
    assert {r.multiplier for r in priors.hook_priors(none, types).collect()} == {1.0}
    many = spark.createDataFrame([("a", 50.0, 0.0)] * 50 + [("b", -50.0, 0.0)] * 50, "hook_type string, hqs double, age_days double")
    got = {r.hook_type: r for r in priors.hook_priors(many, types, seed="s").collect()}
    assert (got["a"].multiplier, got["b"].multiplier, got["c"].n_eff) == (1.25, 0.8, 0.0)
    assert all(0.8 <= r.sampled_multiplier <= 1.25 for r in got.values())


def test_newest_and_upsert(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id long, name string, v double")
    b = spark.createDataFrame([(2, 5.0, 1), (2, 6.0, 2), (3, 7.0, 1)], "id long, v double, at int")
    once = store.upsert(a, b, ["id"], "at")
    assert [tuple(r) for r in once.orderBy("id").collect()] == [(1, "x", 1.0), (2, "y", 6.0), (3, None, 7.0)]
    assert sorted(map(str, store.upsert(once, b, ["id"], "at").collect())) == sorted(map(str, once.collect()))


def test_dedupe_gap_compares_with_last_kept(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1), (1, 1, 5.0, 2), (1, 2, 9.0, 1), (1, 3, 20.0, 1)], "v int, id long, t double, votes long")
    assert sorted(r.id for r in segments.dedupe_gap(rows, "v", 6.0).collect()) == [1, 3]
    odd = spark.createDataFrame([(None, 1, 0.0, None), (None, 2, 1.0, 3), (1, 3, None, 1), (1, 4, 7.0, 5), (1, 5, 7.0, 5), (1, 6, 8.0, None)], "v int, id long, t double, votes long")
    assert sorted((str(r.v), r.id) for r in segments.dedupe_gap(odd, "v", 6.0).collect()) == [("1", 4), ("None", 2)]
    assert segments.dedupe_gap(rows.limit(0), "v", 6.0).count() == 0


def test_order_statistics_of_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *(round(rng.gauss(0, 5), 1) for _ in range(6))]), "x") for _ in range(500)] + [("one", 7.0, "x"), ("none", None, "x")]
    df = spark.createDataFrame(data, "g string, x double, rank string").drop("rank").repartition(5)
    from tallyframe.operators import ranks

    want = {r.g: r for r in df.groupBy("g").agg(F.expr("percentile(x, array(0.25, 0.5, 0.95))").alias("p"), F.sort_array(F.collect_list("x")).alias("v")).collect() if r.v}
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "x", [0.25, 0.5, 0.95]).collect()}
    assert {k: [r.q0, r.q1, r.q2] for k, r in got.items()} == {k: r.p for k, r in want.items()}
    assert {r.g: r.median for r in ranks.upper_medians(df, ["g"], "x").collect()} == {k: r.v[len(r.v) // 2] for k, r in want.items()}
    mad = {r.g: (r.median, r.mad) for r in ranks.median_deviations(df, ["g"], "x").collect()}
    assert mad == {k: (float(np.median(r.v)), float(np.median(np.abs(np.array(r.v) - np.median(r.v))))) for k, r in want.items()}


def test_paths_fold_from_cut_to_cut(spark):
    rng = random.Random(2)
    data, t = [], 0.0
    for u in (1, 2):
        shot = 0
        for i in range(150):
            t += rng.choice([0.1, 0.5])
            shot += rng.random() < 0.1
            data.append((u, i, t, rng.choice([None, 50.0, 60.0, 90.0]), shot, rng.choice([20.0, 50.0, 80.0])))
    df = spark.createDataFrame(data, "u int, ordinal int, t double, x double, shot int, anchor double").repartition(4)
    got = {(r.u, r.t): r.x for r in timeseries.ema_path(df, "u", 100.0, 20.0).collect()}
    for u in (1, 2):
        own = [d for d in data if d[0] == u]
        aim = np.array([np.nan if d[3] is None else min(max(d[5] - 10, 0), 80) for d in own])
        cut = np.array([False, *(a[4] != b[4] for a, b in zip(own, own[1:], strict=False))])
        path = timeseries.smooth(np.array([d[2] for d in own]), aim, cut, own[0][5] - 10, 6.0, 0.12, 18.0, 80.0)
        assert [got[u, d[2]] for d in own] == [round(float(x), 6) for x in path]


def test_active_speaker_is_sticky(spark):
    frames = [
        ("c", 0, []), ("c", 1, [(100.0, 9.0, 0.0)]), ("c", 2, [(100.0, 9.0, 1.0), (500.0, 5.0, 1.5)]), ("c", 3, [(100.0, 9.0, 1.0), (500.0, 5.0, 2.0)]), ("c", 4, None), ("c", 5, [(110.0, 9.0, 0.0), (480.0, 5.0, 0.0), (300.0, 1.0, 99.0)]),
        ("d", 0, [(10.0, 1.0, None), (20.0, 3.0, None)]), ("d", 1, [(None, 9.0, 9.0), (12.0, 1.0, 0.0), (24.0, 2.0, 0.0)]),
    ]
    df = spark.createDataFrame(frames, "clip string, frame int, faces array<struct<cx:double,area:double,energy:double>>")
    got = {(r.clip, r.frame): r.active for r in timeseries.active_speaker(df, "clip").collect()}
    assert [got["c", i] for i in range(6)] == [None, 100.0, 100.0, 500.0, None, 0.65 * 480 + 0.35 * 500]
    assert [got["d", i] for i in range(2)] == [20.0, pytest.approx(0.65 * 24 + 0.35 * 20)]


def test_merge_short_and_split_long(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 10.0, "a b", 2), (1, 1, 10.0, 12.0, "c", 1), (1, 2, 12.0, 40.0, "d e f g", 4)], "v int, seg long, start double, end double, text string, word_count long")
    m = segments.merge_short(s, "v", 5.0).orderBy("seg").collect()
    assert [(r.start, r.end, r.text, r.word_count) for r in m] == [(0.0, 12.0, "a b c", 3), (12.0, 40.0, "d e f g", 4)]
    assert [r.text for r in segments.split_long(s, "v", 14.0).where("seg = 2").orderBy("k").collect()] == ["d", "e", "f"]


def test_rdp_and_smooth():
    t = np.arange(5.0)
    assert timeseries.simplified(t, np.array([0, 1, 2, 3, 4.0]), 0.1).tolist() == [0, 4]
    assert timeseries.simplified(t, np.array([0, 0, 10, 0, 0.0]), 1.0).tolist() == [0, 1, 2, 3, 4]
    path = timeseries.smooth(t, np.array([50, np.nan, 50, 90, 90.0]), np.array([0, 0, 0, 1, 0], bool), 0.0, 1.0, 0.5, 10.0, 100.0)
    assert path.tolist() == [0.01, 0.01, 10.01, 90.0, 90.0]


def test_interpolation_clamps(spark):
    df = spark.sql("SELECT array(named_struct('x', 0.2D, 'y', 1.0D), named_struct('x', 0.6D, 'y', 0.5D)) AS c")
    at = lambda x, low=True: timeseries.interpolate(F.col("c"), F.lit(x), low)
    assert list(df.select(at(0.1), at(0.1, False), at(0.4), at(0.6), at(0.9)).first()) == pytest.approx([1.0, 0.5, 0.75, 0.5, 0.5])


def test_turkish_text(spark):
    df = spark.createDataFrame([("Işık İstanbul",)], "t string")
    row = df.select(tx.tr_upper(F.col("t")), tx.tr_lower(F.col("t")), tx.tr_title(F.lower(F.lit("ılık iz"))), tx.ascii_fold(F.col("t")), tx.nfc(F.lit("ş"))).first()
    assert list(row) == ["IŞIK İSTANBUL", "ışık istanbul", "Ilık İz", "Isik Istanbul", "ş"]
    n = spark.createDataFrame([("kırk beş bin lira, yüzde ikisi",)], "t string").select(tx.spelled_numbers(F.col("t")).alias("n")).first().n
    assert n == [2, 5, 40, 100, 102, 1000, 45000]
    q = spark.createDataFrame([("Neden 18 milyon? Bu mu?", "Bu yüzden olmaz.", "olur mu?")], "a string, b string, p string").select(tx.numeric_density(F.col("a")), tx.question_density(F.col("a")), tx.self_contained(F.col("b"), F.col("p"))).first()
    assert list(q) == pytest.approx([40.0, 80.0, 3.0])


def test_urls_round_trip(spark):
    df = spark.createDataFrame([("https://e.com/a?ref=p%20q&ref=z#f",), ("https://e.com",)], "u string")
    built = df.select(urls.build(F.col("u"), F.lit("Tik Tok"), F.lit("kesit-ücret"), F.lit("howto"), F.lit(""), F.lit("c"), F.lit(""), F.lit("tr")).alias("u"))
    k = [r.k for r in built.select(urls.parse(F.col("u")).alias("k")).collect()]
    assert {(x.platform, x.clip_id, x.hook_type, x.variant, x.lang, x.run) for x in k} == {("tik-tok", "kesit-cret", "howto", "a", "tr", "")}
    assert "ref=p+q" in built.first().u and df.select(urls.parse(F.col("u"))).first()[0] is None


def test_hash_mod_equals_whole_number(spark):
    import hashlib

    got = [r[0] for r in spark.range(20).select(hashing.sha256_mod(F.col("id").cast("string"), 7)).collect()]
    assert got == [int(hashlib.sha256(str(i).encode()).hexdigest(), 16) % 7 for i in range(20)]


@pytest.mark.parametrize(("raw", "wanted"), [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure! {"a": [1, 2]} done', {"a": [1, 2]}), ('{"a": 1,}', {"a": 1}), ("{“a”: None}", {"a": None}),
    ('{"q": "he said "hi" to us", "b": 2}', {"q": 'he said "hi" to us', "b": 2}),
])
def test_json_repair(raw, wanted):
    assert json.loads(jsonx.repaired(raw)) == wanted


def test_json_repair_gives_up():
    assert jsonx.repaired("no json here") is None and jsonx.repaired(None) is None


def test_copy_gates(spark):
    clip = "maaş 18 milyon lira oldu ve herkes bunu konuşuyor bugün"
    rows = spark.createDataFrame([("c", "x", "kısa metin http://a.b/" + "c" * 300, ["a"], "milyon lira oldu ve herkes bunu", "18", clip), ("c", "linkedin", "uydurma metin", [], "hiç söylenmemiş altı kelimelik bir söz", "77", clip)], "clip_id string, platform string, body string, hashtags array<string>, evidence_quote string, key_number string, clip_text string")
    got = {r.platform: {i.code for i in r.issues} for r in publish.validate_copy(rows, ("uydurma",)).collect()}
    assert got["x"] == {"LINK_IN_BODY"}
    assert got["linkedin"] == {"EVIDENCE_NOT_IN_TRANSCRIPT", "NUMBER_HALLUCINATION", "HASHTAG_COUNT", "BANNED_PHRASE"}


def test_requests_by_platform(spark):
    rows = [
        ("a", "x", "see https://a.b/" + "c" * 300 + " " + "d" * 240, 1, 1.0, "9:16", None, None, None, "https://t"), ("b", "x", "see https://a.b/" + "c" * 300, 1, 150.0, "4:5", None, None, None, None),
        ("c", "youtube", "t", 600 << 20, 180.0, "9:16", None, "soon", "t" * 101, None), ("d", "tiktok", "t", 1, 601.0, "1:1", None, "soon", None, None), ("e", "instagram", None, None, None, None, "", None, None, None),
        ("f", "elsewhere", "t" * 9999, 1, 1.0, None, None, None, None, None), ("g", "linkedin", "t" * 3001, 1, 1.0, "1:1", None, None, None, None), ("h", "instagram", "t", 1, 90.5, "9:16", "https://u", None, None, None),
    ]
    df = spark.createDataFrame(rows, "post_id string, platform string, text string, bytes long, duration_s double, aspect string, public_url string, scheduled_at string, title string, tracking_url string")
    got = {r.post_id: [i.code for i in r.issues] for r in publish.validate_request(df).collect()}
    assert got == {
        "a": ["TEXT_TOO_LONG"], "b": ["ASPECT_UNSUPPORTED", "DURATION_TOO_LONG"], "c": ["MEDIA_TOO_LARGE", "TITLE_TOO_LONG", "QUOTA_COST"], "d": ["ASPECT_UNSUPPORTED", "DURATION_TOO_LONG", "NO_NATIVE_SCHEDULE", "TIKTOK_UNAUDITED"],
        "e": ["ASPECT_UNSUPPORTED", "PUBLIC_URL_REQUIRED"], "f": [], "g": ["TEXT_TOO_LONG"], "h": ["DURATION_TOO_LONG"],
    }
    assert publish.validate_request(df.drop("title", "tracking_url")).count() == 8


def test_crops_and_pulses(spark):
    from tallyframe.operators import quality

    def box(face, scale, aspect, w, h):
        f = F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("xywh", face, strict=True))) if face else F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")
        return tuple(spark.range(1).select(quality.crop_box(f, F.lit(scale), F.lit(aspect), F.lit(w), F.lit(h)).alias("b")).select("b.*").first())

    assert box(None, 0.0, "9:16", 1920, 1080) == (656, 0, 608, 1080)
    assert box((400, 100, 100, 120), 0.5, "9:16", 1920, 1080) == (596, 0, 608, 1080)
    assert box((0, 0, 10, 10), 1.0, "16:9", 1080, 1920) == (0, 0, 1080, 608)
    assert box((900, 1900, 10, 10), 1.0, "16:9", 1080, 1920) == (0, 1312, 1080, 608)
    pulse = lambda *t: spark.range(1).select(quality.defocus_pulses(F.array(*map(F.lit, t)).cast("array<double>"))).first()[0]
    assert pulse() == "" and pulse(1.5, 2.0004) == "7*(max(0\\,1-abs(t-1.5)/0.12)+max(0\\,1-abs(t-2.0)/0.12))"


def test_rubric_of_twelve(spark):
    cols = ", ".join(f"{c} double" for c in perf.RUBRIC)
    df = spark.createDataFrame([("a", *[10.0] * 12), ("b", *[None] * 12), ("c", -1.0, *[0.0] * 10, 99.0)], f"seg string, {cols}")
    rows = perf.rubric_rows(df, "seg")
    got = {r.seg: r for r in perf.rubric_totals(rows, "seg").collect()}
    assert rows.count() == 36 and sum(w for w, _ in perf.RUBRIC.values()) == 100
    assert (got["a"].base, got["a"].deterministic, got["a"].llm, got["a"].unjudged) == (100.0, 45.0, 55.0, 0)
    assert (got["b"].base, got["b"].unjudged) == (50.0, 12) and got["c"].base == 8.0


def test_redaction(spark):
    h = spark.sql("SELECT map('Authorization', 'Bearer abc', 'Accept', 'x') AS h").select(publish.redacted(F.col("h"))).first()[0]
    assert h == {"Authorization": "Bearer [REDACTED]", "Accept": "x"}


def test_success_gate(spark):
    rows = spark.createDataFrame([(True,), (False,)], "ok boolean")
    assert publish.require_success_ratio(rows, F.col("ok"), 0.5).count() == 2
    with pytest.raises(Exception, match="success ratio"):
        publish.require_success_ratio(rows, F.col("ok"), 0.9).collect()


def test_expression_follows_the_polyline(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 10.0), (1, 3.0, 4.0)], "v int, t double, x double")
    text = timeseries.expression(rows, "v").first().expr
    ev = lambda t: eval(text.replace("if(", "f("), {"f": lambda c, a, b: a if c else b, "lt": lambda a, b: a < b, "t": t})  # noqa: E731, S307
    assert [ev(t) for t in (-1, 0, 1, 2, 2.5, 9)] == pytest.approx([0, 0, 5, 10, 7, 4])


def test_pauses_fill_a_window(spark):
    marks = spark.createDataFrame([(1, i, i * 10.0, "pause" if i % 2 else "punctuation") for i in range(40)], "v int, id long, t double, reason string")
    failed = spark.createDataFrame([(1, 0, 0.0, 200.0)], "v int, window int, from double, to double")
    assert [r.id for r in segments.fill_from_pauses(marks, failed, "v").orderBy("t").collect()] == [1, 11]


def test_judging_repairs_and_records_failures(spark):
    from tallyframe.operators import judging

    def judge(prompt, note):
        if prompt == "bad":
            raise ValueError("no")
        return '{"a": 1,}' if note else "nothing"

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, p string")
    got = {r.id: (r.status, r.attempts) for r in judging.judged(rows, "id", "p", judge).collect()}
    assert got == {1: ("ok", 2), 2: ("failed", 3)}


def test_conflicts_of_rows_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a", 0.0, 10.0, None), (1, "a", 0.0, 10.0, None), (2, "a", 100.0, 110.0, None), (3, None, 0.0, 10.0, 1.0), (4, "a", None, 10.0, 1.0)], "id int, video string, start double, end double, score double")
    chosen = spark.createDataFrame([("a", 5.0, 8.0), (None, 5.0, 8.0)], "video string, start double, end double")
    assert sorted(r.id for r in schedule.without_conflicts(rows, chosen, "video", 1.0).collect()) == [2, 3, 4]


@pytest.mark.parametrize("slice_s", [1.0, 3600.0])
def test_nearest_of_repeated_null_and_far_rows(spark, slice_s):
    left = spark.createDataFrame([("a", 5.0, 1), ("a", 5.0, 1), ("a", None, 2), (None, 5.0, 3), ("b", 1.0, 4), ("a", 1e6, 5), ("a", 15.0, 6), ("a", 10.0, 7)], "k string, t double, id int")
    right = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 2.0), ("a", 20.0, 3.0), ("a", None, 9.0), (None, 5.0, 9.0)], "k string, t double, x double")
    got = sorted((r.id, r.x) for r in timeseries.nearest(left, right, "k", "t", "x", slice_s).collect())
    assert got == [(1, 1.0), (1, 1.0), (2, None), (3, None), (4, None), (5, 3.0), (6, 1.0), (7, 1.0)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    left, right = ([(rng.randrange(3), round(rng.uniform(0, 500), 1), i) for i in range(n)] for n in (60, 40))
    got = {r.id: r.x for r in timeseries.nearest(spark.createDataFrame(left, "k int, t double, id int"), spark.createDataFrame(right, "k int, t double, x int"), "k", "t", "x", 20.0).collect()}
    for k, t, i in left:
        best = min(((abs(t - r[1]), r[1], -r[2]) for r in right if r[0] == k), default=None)
        assert got[i] == (None if best is None else -best[2])


def test_english_gates_and_bilingual_posts(spark):
    rows = spark.createDataFrame([("c", "linkedin", "metin", ["a", "b", "c"], None), ("d", "linkedin", "metin", ["a"], "see http://x " + "y" * 3000), ("e", "x", "metin", ["a"], "short Text")], "clip_id string, platform string, body string, hashtags array<string>, body_en string")
    checked = rows.selectExpr("*", "'bir iki üç dört beş altı' AS evidence_quote", "CAST(NULL AS STRING) AS key_number", "'bir iki üç dört beş altı' AS clip_text")
    got = {r.clip_id: {i.code for i in r.issues} for r in publish.validate_copy(checked, ("Short",)).collect()}
    assert got["c"] == set() and got["d"] == {"HASHTAG_COUNT", "EN_LEN_OVER", "EN_LINK_IN_BODY"} and got["e"] == {"EN_BANNED_PHRASE"}
    assert sorted((r.clip_id, r.lang) for r in publish.bilingual(rows).collect()) == [("c", "tr"), ("d", "en"), ("d", "tr"), ("e", "tr")]


def test_cut_wrap_drops_what_does_not_fit(spark):
    from tallyframe.operators import captions

    words = F.array(*map(F.lit, "one two three four five".split()))
    assert spark.range(1).select(captions.wrap_cut(words, 7, 2)).first()[0] == ["one two", "three"]


def test_a_hook_split_over_sentences(spark):
    units = spark.createDataFrame([(1, 0, ["x"]), (1, 1, ["a", "b"]), (1, 2, ["c"]), (1, 3, ["y"])], "d int, unit long, tokens array<string>")
    wanted = spark.createDataFrame([(1, ["a", "b", "c", "e"])], "d int, wanted array<string>")
    assert [tuple(r) for r in segments.locate(units, wanted, "d", 0.7).collect()] == [(1, 1, 0.75)]
    assert [tuple(r) for r in segments.locate(units, wanted, "d", 0.5).collect()] == [(1, 1, 0.5)]
    assert segments.locate(units, wanted, "d", 0.9).count() == 0


def test_gates_and_verdicts(spark):
    from tallyframe.operators import quality

    row = spark.range(1).select(
        quality.gate({"eyes": F.lit(0.2), "frontal": F.lit(0.9)}, F.lit(True)).alias("half"), quality.gate({"eyes": F.lit(0.5)}, F.lit(False)).alias("none"), quality.frontality(F.lit(0.0), F.lit(10.0), F.lit(5.0)).alias("front"),
        quality.cut_verdict(F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(1), F.lit(1.0)).alias("jump"), quality.cut_verdict(F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.1)).alias("dip"),
    ).first()
    assert row.half == pytest.approx(0.3 + 0.7 * 0.25) and row.none == 0.35 and row.front == 1.0 and (row.jump, row.dip) == ("jump_cut", "transitioned")


def test_reports_refuse_to_shorten(spark):
    from tallyframe.sources import writers

    with pytest.raises(ValueError):
        writers.markdown(spark.range(5), most=4)


def test_upsert_has_no_gap_for_readers(spark, tmp_path, monkeypatch):
    from tallyframe.sources import readers, writers

    path = f"{tmp_path}/videos"
    rows = lambda *x: spark.createDataFrame(x, "video_id string, title string, at int")
    ids = lambda df: sorted(r.video_id for r in df.collect())
    writers.upsert_table(rows(("a", "x", 1)), path, "videos", "at")
    begun = readers.maybe_table(spark, path, "videos")  # a reader that starts before the next write
    with monkeypatch.context() as m:
        m.setattr(writers, "switch_pointer", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            writers.upsert_table(rows(("lost", "y", 1)), path, "videos", "at")
    assert ids(readers.maybe_table(spark, path, "videos")) == ["a"]  # a write that ended early changed nothing
    writers.upsert_table(rows(("b", "y", 1)), path, "videos", "at")
    assert ids(readers.maybe_table(spark, path, "videos")) == ["a", "b"] and ids(begun) == ["a"]
    writers.upsert_table(rows(("c", "y", 1)), path, "videos", "at")
    assert len([x for x in (tmp_path / "videos").iterdir() if x.name.startswith("v-")]) == 2


def test_a_run_is_counted_by_its_writes(spark, tmp_path):
    from tallyframe.sources import writers

    tries = spark.sparkContext.accumulator(0)

    def touched(batches):
        for b in batches:
            tries.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "video_id string, title string, at int").mapInArrow(touched, "video_id string, title string, at int")
    assert writers.record_run({"videos": (df, "at"), "clips": (spark.createDataFrame([], "clip_id string, at int"), "at")}, str(tmp_path)) == {"videos": 3, "clips": 0}
    assert tries.value == 3  # each input is worked out once


def test_candidate_runs_carry_their_texts(spark):
    units = [("a", 0, 0.0, 6.0, "one"), ("a", 1, 6.0, 9.0, None), ("a", 2, 9.0, 15.0, "three"), ("a", 3, 30.0, 45.0, "four"), ("b", 0, 0.0, 12.0, "own"), (None, 0, 0.0, 12.0, "none")]
    df = spark.createDataFrame(units, "g string, unit long, start double, end double, text string")
    want = sorted((g, a, z, " ".join(t for *_, t in run if t)) for g in "ab" for a in range(4) for z in range(a, 4) if (run := [u for u in units if u[0] == g and a <= u[1] <= z]) and len(run) == z - a + 1 and 8 <= run[-1][3] - run[0][2] <= 16)
    got = segments.candidate_runs(df, "g", 8.0, 16.0).collect()
    assert sorted((r.g, r.first, r.last, r.text) for r in got) == want
    assert sorted((r.g or "", r.first, r.last) for r in segments.candidate_runs(df, "g", 8.0, 16.0, text=False).where("g is not null").collect()) == [x[:3] for x in want]


def test_covers_are_cut_by_a_pattern(spark):
    """Words of any length, exact fits, and no fold over the words."""
    from tallyframe.operators import captions

    rows = spark.createDataFrame([(["seven77", "a", "bc"],), (["1234", "67", "9"],), (["longerthanseven", "x"],), (["a"] * 30,), ([],)], "w array<string>")
    cut = rows.select(captions.wrap_cut(F.col("w"), 7, 2).alias("l"))
    assert [r.l for r in cut.collect()] == [["seven77", "a bc"], ["1234 67", "9"], ["longerthanseven", "x"], ["a a a a", "a a a a"], []]
    assert "aggregate(" not in cut._jdf.queryExecution().optimizedPlan().toString()

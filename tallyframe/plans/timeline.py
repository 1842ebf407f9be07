"""Queries on slots, intervals and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import schedule as sch
from ..operators import segments as seg
from ..operators import timeseries as ts
from ..operators.performance import half_up
from . import views as v

PLATFORMS, KINDS = ("linkedin", "instagram", "x", "tiktok", "youtube"), ("data_number", "contrarian", "howto", "story", "question")


def slot_posts(s, d):
    p = v.posts(s, d)
    pick = lambda c, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(c, F.lit(len(xs))) + 1).cast("int"))
    return p.select("post_id", "clip_id", pick(F.col("post_id"), PLATFORMS).alias("platform"), pick(F.col("clip_id"), KINDS).alias("hook_type"), F.timestamp_add("HOUR", F.lit(7), F.col("published_at")).alias("now"))


def ab_clone(s, d):
    pair = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.lit("plain").alias("effect")), F.struct(F.lit("B").alias("side"), F.lit("blur").alias("effect")))).alias("x")
    return v.posts(s, d).select("clip_id").distinct().select("clip_id", pair).select(F.concat(F.col("clip_id").cast("string"), F.lower("x.side")).alias("new_id"), F.col("clip_id").alias("ab_group"), F.col("x.effect").alias("effect"))


def aspect_routing(s, d):
    routes = F.when(F.col("post_id") % 2 == 0, F.array(*map(F.lit, ("instagram", "tiktok", "youtube")))).otherwise(F.array(F.lit("linkedin"), F.lit("x")))
    return v.posts(s, d).select("post_id", F.explode(routes).alias("platform"))


def hash_variant(s, d):
    return v.posts(s, d).select("post_id", hashing.sha256_mod(F.concat(F.lit("seed|render_variant|"), F.col("post_id").cast("string")), 3).alias("variant"))


def slot_candidates(s, d):
    return sch.slot_candidates(slot_posts(s, d)).drop("platform", "hook_type")


def slot_topk(s, d):
    """The second to fifth slots of each post."""
    return sch.best_slots(slot_posts(s, d), 2, 5)


def plan_slots(s, d):
    """Posts of ten videos, each of many clips."""
    return sch.plan_slots(slot_posts(s, d).withColumn("video", F.col("clip_id") % 10), "video", "clip_id")


def sha1_jitter(s, d):
    return v.posts(s, d).select("post_id", hashing.jitter_minutes(F.col("post_id").cast("string")).alias("minutes"))


def holiday_filter(s, d):
    return v.posts(s, d).where(sch.is_holiday(F.col("published_at"))).select("post_id", "published_at")


def gap_hours(s, d):
    w = Window.partitionBy("clip_id").orderBy("published_at", "post_id")
    t = v.posts(s, d).select("clip_id", "post_id", "published_at", F.lag("published_at").over(w).alias("before"))
    h = F.timestamp_diff("HOUR", F.col("before"), F.col("published_at"))
    return t.select("post_id", h.alias("hours"), F.coalesce(h < sch.MIN_GAP_H, F.lit(False)).alias("too_close"))


def iso_parse(s, d):
    text = F.when(F.col("post_id") % 10 == 0, "n/a").otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return v.posts(s, d).select("post_id", F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")).cast("timestamp_ntz").alias("parsed"))


def window_end(s, d):
    """End of each metric window after publishing, no later than a fixed now; none for those to come."""
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    days = F.explode(F.array(*map(F.lit, (1, 7, 30)))).alias("days")
    p = v.posts(s, d).select("post_id", "published_at", days)
    return p.where(F.col("published_at") < now).select("post_id", "days", F.least(now, F.timestamp_add("DAY", F.col("days"), F.col("published_at"))).alias("until"))


def tz_shift(s, d):
    local = F.timestamp_add("HOUR", F.lit(3), F.col("published_at"))
    return v.posts(s, d).select("post_id", F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'+03:00'").alias("local"), F.when(F.hour(local) < 15, "morning").otherwise("evening").alias("part"))


def age_days(s, d):
    end = F.lit("1998-12-31 12:00:00").cast("timestamp")
    return v.posts(s, d).select("post_id", F.round((F.unix_micros(end) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 86400e6, 6).alias("age"))


def score_shapes(s, d):
    x = F.col("completion_rate")
    box = F.floor(1080 * 9 / 16 / 2 + x * 100) * 2
    return v.metrics(s, d).select("post_id", "window", F.round(F.exp(-F.pow((x - 1 / 3) / 0.15, 2) / 2), 6).alias("thirds"), F.round(F.greatest(F.lit(0.0), 1 - F.abs(x - 0.35) / 0.25), 6).alias("size"), F.round(F.pow(1 - x, 2), 6).alias("gate"), box.alias("even_width"))


def chosen(s, d):
    """The intervals already chosen: the best of each type and hour."""
    i = v.intervals(s, d)
    return i.groupBy("video", F.floor(F.col("start") / 3600)).agg(F.max_by(F.struct(*i.columns), F.struct("score", "event_id")).alias("r")).select("r.*")


def interval_conflicts(s, d):
    return sch.without_conflicts(v.intervals(s, d), chosen(s, d), "video", 5.0, 43200.0).select("event_id", "video")


def range_words(s, d):
    """Words of each line's time on the words' clock: an equi-join by document and slice of time with the range as residue."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = v.sentences(s, d).withColumn("last", F.sum(F.size("tokens")).over(w)).withColumn("from", F.round(0.3 * (F.col("last") - F.size("tokens")), 3)).withColumn("to", F.round(0.3 * F.col("last"), 3)).select("doc_id", "line", "from", "to")
    lines = lines.withColumn("part", F.explode(F.sequence(F.floor((F.col("from") - 0.3) / 6), F.floor((F.col("to") + 0.01) / 6))))
    j = v.words(s, d).withColumn("part", F.floor(F.col("start") / 6)).join(lines, ["doc_id", "part"]).where("end > `from` - 0.01 and start < `to` + 0.01")
    return j.groupBy("doc_id", "line").agg(F.count("*").alias("n"))


def nearest_energy(s, d):
    e = v.samples(s, d)
    left = e.where("cut = 1").select("user_id", "event_id", "t")
    right = e.where("cut = 0 and x is not null").groupBy("user_id", "t").agg(F.max("x").alias("x"))
    return ts.nearest(left, right, "user_id", "t", "x", 86400.0).select("event_id", "x")


def interp_curve(s, d):
    """Each post's completion along its windows, read a little past the first."""
    pts = v.metrics(s, d).select("post_id", F.substring("window", 2, 9).cast("double").alias("x"), F.col("completion_rate").alias("y"))
    c = pts.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("c"))
    return c.select("post_id", half_up(ts.interpolate(F.col("c"), F.col("c")[0]["x"] + 0.25), 5).alias("y"), F.round(ts.interpolate(F.col("c"), F.lit(0.5), False), 6).alias("before"))


def shots(s, d):
    return seg.islands(v.samples(s, d), "user_id", ["t", "event_id"], F.col("cut") == 1, "shot")


def shot_anchor(s, d):
    a = ts.anchors(shots(s, d), ["user_id", "shot"], "x", 20.0)
    return a.select("user_id", "shot", "median", F.round("anchor", 6).alias("anchor"))


def travel(s, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    t = v.samples(s, d).where("x is not null").withColumn("step", F.abs(F.col("x") - F.lag("x").over(w)))
    return t.groupBy("user_id").agg(F.round(F.sum("step"), 6).alias("travel"), F.round(F.max(F.abs(F.col("x") - 50)), 6).alias("offset"))


def running_min(s, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return v.samples(s, d).select("event_id", F.min("x").over(w).alias("low"))


def shot_from_diff(s, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    t = v.samples(s, d).where("x is not null").withColumn("cut", F.coalesce(F.abs(F.col("x") - F.lag("x").over(w)) > 28, F.lit(False)))
    return t.groupBy("user_id").agg(F.count_if("cut").alias("cuts"))


def frames(s, d):
    """Each user's events as frames of up to three faces."""
    at, parts = F.floor(F.col("value") * 100), []
    for i in range(3):
        parts.append(F.struct(((at * (i + 1)) % 1000).cast("double").alias("cx"), ((F.col("event_id") * (i + 3)) % 97).cast("double").alias("area"), ((at * (i + 2)) % 13).cast("double").alias("energy")))
    return v.table(s, d, "events").select("user_id", F.col("event_id").alias("frame"), F.slice(F.array(*parts), F.lit(1), (F.col("event_id") % 4).cast("int")).alias("faces"))


def speaker_pick(s, d):
    return ts.active_speaker(frames(s, d), "user_id").select("user_id", "frame", F.round("active", 6).alias("active"))


def daily(s, d):
    """Intervals of an hour and more, by type and day, so that many fit."""
    day = F.floor(F.col("start") / 86400).cast("string")
    return v.intervals(s, d).withColumn("video", F.concat_ws("|", "video", day)).withColumn("kind", F.when(F.col("event_id") % 3 == 0, "story").otherwise("howto"))


def schedule_k(s, d):
    return sch.schedule(daily(s, d), "video", "event_id", 3, 5.0).drop("threshold")


def explore_quota(s, d):
    return sch.schedule(daily(s, d), "video", "event_id", 3, 5.0, "kind", frozenset({"howto"})).drop("threshold")


def relaxed_schedule(s, d):
    return sch.schedule(daily(s, d), "video", "event_id", 3, 5.0, thresholds=(55.0, 50.0, 45.0, 40.0))


def select_with_quota(s, d):
    rows = daily(s, d).select("video", F.col("event_id").alias("id"), "score", F.col("kind").alias("hook_type"))
    return sch.greedy_with_quota(rows, "video", 5, F.when(F.col("hook_type") == "howto", 1.1).otherwise(1.0), ("howto",))


def tracked(s, d):
    rows = shots(s, d).withColumnRenamed("event_id", "ordinal")
    a = ts.anchors(rows, ["user_id", "shot"], "x", 20.0).select(F.col("user_id").alias("a_u"), F.col("shot").alias("a_s"), F.col("anchor"))
    return rows.join(a, (F.col("user_id") == F.col("a_u")) & (F.col("shot") == F.col("a_s")), "left").select("user_id", "ordinal", "t", "x", "shot", "anchor")


def ema_path(s, d):
    return ts.ema_path(tracked(s, d), "user_id", 100.0, 20.0)


def rdp_path(s, d):
    return ts.rdp_path(v.samples(s, d), "user_id", 10.0)


def dedupe_gap(s, d):
    rows = v.samples(s, d).select("user_id", F.col("event_id").alias("id"), "t", F.coalesce(F.floor("x"), F.lit(0)).alias("votes"))
    return seg.dedupe_gap(rows, "user_id", 86400.0)


QUERIES = {f.__name__: f for f in (
    ab_clone, aspect_routing, hash_variant, slot_candidates, slot_topk, plan_slots, sha1_jitter, holiday_filter, gap_hours, iso_parse, window_end, tz_shift, age_days, score_shapes, interval_conflicts, range_words, nearest_energy, interp_curve,
    shot_anchor, travel, running_min, shot_from_diff, speaker_pick, schedule_k, explore_quota, relaxed_schedule, select_with_quota, ema_path, rdp_path, dedupe_gap,
)}

_P, _M, _I, _SA = f"WITH {v.POSTS}", f"WITH {v.METRICS}", f"WITH {v.INTERVALS}", f"WITH {v.SAMPLES}"
_RULES = ", ".join(f"('{i}', '{p}', {list(w)}, {a}, {x}::DOUBLE)" for i, p, w, a, _, x in sch.RULES)
_BONUS = " ".join(f"WHEN hook_type = '{h}' THEN CASE WHEN hour(slot) < 15 THEN {a}::DOUBLE ELSE {b}::DOUBLE END" for h, (a, b) in sch.CONTENT.items())
_SLOTS = f"""sp AS (SELECT post_id, clip_id, (['linkedin', 'instagram', 'x', 'tiktok', 'youtube'])[post_id % 5 + 1] AS platform, (['data_number', 'contrarian', 'howto', 'story', 'question'])[clip_id % 5 + 1] AS hook_type, published_at + INTERVAL 7 HOUR AS now FROM posts),
r(rule, p, weekdays, minute, weight) AS (VALUES {_RULES}),
c AS (SELECT sp.*, day, rule, weight, weekdays, date_trunc('day', now + to_days(day::INTEGER)) + to_minutes(minute) AS slot FROM sp JOIN r ON p = platform, range(7) g(day)),
slots AS (SELECT post_id, day::INTEGER AS day, rule, slot::TIMESTAMP AS slot, round(weight + CASE {_BONUS} ELSE 0 END - day * 0.02::DOUBLE, 4) AS score FROM c WHERE list_contains(weekdays, isodow(slot) - 1) AND slot > now + INTERVAL 30 MINUTE)"""
_SHOT = "shots AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS shot FROM samples)"
#: Days of intervals, and the best set of up to three of a pool's: as many as possible, then the highest total.
_DAILY = "d AS (SELECT video || '|' || floor(start / 86400)::BIGINT AS video, event_id, start, \"end\", score, CASE WHEN event_id % 3 = 0 THEN 'story' ELSE 'howto' END AS kind FROM intervals)"
_SETS = """sets AS (
  SELECT video, t, 1 AS n, [event_id] AS ids, score AS total FROM pool
  UNION ALL SELECT a.video, a.t, 2, [a.event_id, b.event_id], a.score + b.score FROM pool a JOIN pool b ON a.video = b.video AND a.t = b.t AND a."end" + 5 <= b.start
  UNION ALL SELECT a.video, a.t, 3, [a.event_id, b.event_id, c.event_id], a.score + b.score + c.score FROM pool a JOIN pool b ON a.video = b.video AND a.t = b.t AND a."end" + 5 <= b.start JOIN pool c ON b.video = c.video AND b.t = c.t AND b."end" + 5 <= c.start
), best AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY video, t ORDER BY n DESC, total DESC) = 1)"""
SQL = {
    "ab_clone": f"{_P} SELECT clip_id || s AS new_id, clip_id AS ab_group, e AS effect FROM (SELECT DISTINCT clip_id FROM posts), (VALUES ('a', 'plain'), ('b', 'blur')) x(s, e)",
    "aspect_routing": f"{_P} SELECT post_id, unnest(CASE WHEN post_id % 2 = 0 THEN ['instagram', 'tiktok', 'youtube'] ELSE ['linkedin', 'x'] END) AS platform FROM posts",
    "hash_variant": f"""{_P} SELECT post_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda i: ('0x' || substr(h, i * 8 + 1, 8))::BIGINT)), lambda a, x: (a * 4294967296 + x) % 3) AS variant FROM (SELECT post_id, sha256('seed|render_variant|' || post_id) AS h FROM posts)""",
    "slot_candidates": f"{_P}, {_SLOTS} SELECT * FROM slots",
    "slot_topk": f"{_P}, {_SLOTS} SELECT post_id, rule, slot, score, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, day, rule) AS rn FROM slots) WHERE rn BETWEEN 2 AND 5",
    "plan_slots": f"""WITH RECURSIVE {v.POSTS}, {_SLOTS}, n AS (
  SELECT sp.*, clip_id % 10 AS video, row_number() OVER (PARTITION BY clip_id % 10 ORDER BY post_id) AS rn, ('0x' || left(sha1(post_id::VARCHAR), 4))::INTEGER % 25 - 12 AS jitter,
    (SELECT list({{'slot': slot, 'rule': rule, 'score': score}} ORDER BY score DESC, day, rule) FROM slots WHERE slots.post_id = sp.post_id) AS c FROM sp),
k(video, rn, post_id, clip_id, platform, pick, due, notes, taken) AS (
  SELECT DISTINCT video, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::STRUCT(slot TIMESTAMP, rule VARCHAR, score DOUBLE), NULL::TIMESTAMP, NULL::VARCHAR[], []::STRUCT(platform VARCHAR, clip_id BIGINT, due TIMESTAMP)[] FROM n
  UNION ALL
  SELECT video, rn, post_id, clip_id, platform, pick, due, notes, list_append(taken, {{'platform': platform, 'clip_id': clip_id, 'due': due}}) FROM (
    SELECT *, pick.slot + CASE WHEN near THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END + to_minutes(jitter) AS due,
      list_concat(list_concat(list_transform(range(skipped), lambda i: 'G3_holiday_skipped'), CASE WHEN first IS NULL THEN ['G1_relaxed_no_free_slot'] ELSE [] END), list_append(CASE WHEN near THEN ['G2_cross_platform_stagger'] ELSE [] END, 'G5_jitter_applied')) AS notes
    FROM (SELECT *, len(list_filter(taken, lambda t: t.clip_id = x.clip_id AND abs(epoch(t.due) - epoch(pick.slot)) < 1800)) > 0 AS near FROM (
      SELECT *, coalesce(free[first], c[1]) AS pick, coalesce(first - 1, len(free)) AS skipped FROM (
        SELECT *, list_position(list_transform(free, lambda f: month(f.slot) * 100 + day(f.slot) IN ({', '.join(str(m * 100 + d) for m, d in sch.HOLIDAYS)})), false) AS first FROM (
          SELECT n.video, n.rn, n.post_id, n.clip_id, n.platform, n.jitter, n.c, k.taken, list_filter(n.c, lambda f: len(list_filter(k.taken, lambda t: t.platform = n.platform AND abs(epoch(t.due) - epoch(f.slot)) < 14400)) = 0) AS free
          FROM k JOIN n ON n.video = k.video AND n.rn = k.rn + 1))) x)))
SELECT video, post_id, clip_id, platform, pick.rule AS rule, due AS slot, pick.score AS score, array_to_string(notes, ',') AS constraints FROM k WHERE rn > 0""",
    "sha1_jitter": f"{_P} SELECT post_id, (('0x' || left(sha1(post_id::VARCHAR), 4))::INTEGER % 25 - 12)::INTEGER AS minutes FROM posts",
    "holiday_filter": f"{_P} SELECT post_id, published_at FROM posts WHERE month(published_at) * 100 + day(published_at) IN ({', '.join(str(m * 100 + d) for m, d in sch.HOLIDAYS)})",
    "gap_hours": f"{_P} SELECT post_id, (epoch_us(published_at) - epoch_us(lag(published_at) OVER w)) // 3600000000 AS hours, coalesce((epoch_us(published_at) - epoch_us(lag(published_at) OVER w)) // 3600000000 < 4, false) AS too_close FROM posts WINDOW w AS (PARTITION BY clip_id ORDER BY published_at, post_id)",
    "iso_parse": f"{_P} SELECT post_id, CASE WHEN post_id % 10 <> 0 THEN date_trunc('second', published_at)::TIMESTAMP END AS parsed FROM posts",
    "window_end": f"{_P} SELECT post_id, d::INTEGER AS days, least(TIMESTAMP '1998-01-01', published_at + to_days(d))::TIMESTAMP AS until FROM posts, (VALUES (1), (7), (30)) x(d) WHERE published_at < TIMESTAMP '1998-01-01'",
    "tz_shift": f"{_P} SELECT post_id, strftime(published_at + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S+03:00') AS \"local\", CASE WHEN hour(published_at + INTERVAL 3 HOUR) < 15 THEN 'morning' ELSE 'evening' END AS part FROM posts",
    "age_days": f"{_P} SELECT post_id, round((epoch_us(TIMESTAMP '1998-12-31 12:00:00') - epoch_us(published_at)) / 86400e6, 6) AS age FROM posts",
    "score_shapes": f"""{_M} SELECT post_id, "window", round(exp(-power((completion_rate - 1 / 3) / 0.15::DOUBLE, 2) / 2), 6) AS thirds, round(greatest(0.0::DOUBLE, 1 - abs(completion_rate - 0.35::DOUBLE) / 0.25::DOUBLE), 6) AS size, round(power(1 - completion_rate, 2), 6) AS gate,
  (floor(1080 * 9 / 16 / 2 + completion_rate * 100) * 2)::BIGINT AS even_width FROM metrics""",
    "interval_conflicts": f"""{_I} , chosen AS (SELECT * FROM intervals QUALIFY row_number() OVER (PARTITION BY video, floor(start / 3600) ORDER BY score DESC, event_id DESC) = 1)
SELECT event_id, video FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.video = i.video AND i.start < c."end" + 5 AND c.start < i."end" + 5)""",
    "range_words": f"""WITH {v.WORDS}, {v.SENTENCES}, l AS (SELECT doc_id, line, round(0.3::DOUBLE * (sum(len(tokens)) OVER (PARTITION BY doc_id ORDER BY line) - len(tokens)), 3) AS f, round(0.3::DOUBLE * sum(len(tokens)) OVER (PARTITION BY doc_id ORDER BY line), 3) AS u FROM sentences), p AS (SELECT doc_id, line, f, u, unnest(range(floor((f - 0.3) / 6)::BIGINT, floor((u + 0.01) / 6)::BIGINT + 1)) AS part FROM l)
SELECT doc_id, line, count(*) AS n FROM (SELECT *, floor(start / 6)::BIGINT AS part FROM words) JOIN p USING (doc_id, part) WHERE "end" > f - 0.01 AND start < u + 0.01 GROUP BY 1, 2""",
    "nearest_energy": f"""{_SA}, r AS (SELECT user_id, t, max(x) AS x FROM samples WHERE cut = 0 AND x IS NOT NULL GROUP BY 1, 2), l AS (SELECT * FROM samples WHERE cut = 1),
a AS (SELECT l.event_id, l.t AS t, l.user_id, r.t AS a_t, r.x AS ax FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t), b AS (SELECT a.*, r.t AS b_t, r.x AS bx FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t <= r.t)
SELECT event_id, CASE WHEN b_t IS NULL OR t - a_t <= b_t - t THEN ax ELSE bx END AS x FROM b""",
    "interp_curve": f"""{_M}, p AS (SELECT post_id, substr("window", 2)::DOUBLE AS x, completion_rate AS y FROM metrics), q AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS rn, last_value(y) OVER (PARTITION BY post_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ly FROM p WINDOW w AS (PARTITION BY post_id ORDER BY x))
SELECT post_id, floor((CASE WHEN x1 IS NULL THEN ly ELSE y + 0.25::DOUBLE / (x1 - x) * (y1 - y) END) * 1e5 + 0.5::DOUBLE) / 1e5 AS y, round(ly, 6) AS before FROM q WHERE rn = 1""",
    "shot_anchor": f"""{_SA}, {_SHOT}, m AS (SELECT user_id, shot, list_sort(list(x)) AS v FROM shots WHERE x IS NOT NULL GROUP BY 1, 2), n AS (SELECT user_id, shot, v, v[len(v) // 2 + 1] AS median FROM m)
SELECT user_id, shot, median, round(list_avg(list_filter(v, lambda y: abs(y - median) <= 20)), 6) AS anchor FROM n""",
    "select_with_quota": f"""{_I}, d AS (SELECT video || '|' || floor(start / 86400)::BIGINT AS video, event_id AS id, score, CASE WHEN event_id % 3 = 0 THEN 'story' ELSE 'howto' END AS hook_type FROM intervals),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score * CASE WHEN hook_type = 'howto' THEN 1.1::DOUBLE ELSE 1 END DESC, id) AS rn FROM d), o AS (SELECT *, rn <= 4 AS greedy, rn > 4 AND hook_type <> 'howto' AS other FROM r),
q AS (SELECT *, other AND row_number() OVER (PARTITION BY video, other ORDER BY rn) <= 1 AS quota FROM o), t AS (SELECT *, greedy OR quota AS taken FROM q),
f AS (SELECT *, 5 - count_if(taken) OVER (PARTITION BY video) AS spare, row_number() OVER (PARTITION BY video, taken ORDER BY rn) AS fn FROM t)
SELECT * FROM (SELECT video, id, score, hook_type, CASE WHEN greedy THEN 'greedy' WHEN quota THEN 'exploration_quota' WHEN fn <= spare THEN 'greedy_fill' END AS selected_reason FROM f) WHERE selected_reason IS NOT NULL""",
    "schedule_k": f"""{_I}, {_DAILY}, pool AS (SELECT *, 0 AS t FROM d), {_SETS}
SELECT d.video, d.event_id, d.start, d."end", d.score FROM (SELECT video, unnest(ids) AS event_id FROM best) JOIN d USING (video, event_id)""",
    "relaxed_schedule": f"""{_I}, {_DAILY}, pool AS (SELECT d.*, t, low FROM d JOIN (VALUES (0, 55.0::DOUBLE), (1, 50.0::DOUBLE), (2, 45.0::DOUBLE), (3, 40.0::DOUBLE)) x(t, low) ON score >= low), {_SETS},
level AS (SELECT video, coalesce(min(t) FILTER (n = 3), 3) AS t FROM best GROUP BY video)
SELECT d.video, d.event_id, d.start, d."end", d.score, 55 - 5 * t::DOUBLE AS threshold FROM (SELECT video, t, unnest(ids) AS event_id FROM best JOIN level USING (video, t)) JOIN d USING (video, event_id)""",
    "explore_quota": f"""{_I}, {_DAILY}, pool AS (SELECT *, 0 AS t FROM d), {_SETS},
picked AS (SELECT d.* FROM (SELECT video, unnest(ids) AS event_id FROM best) JOIN d USING (video, event_id)),
few AS (SELECT video FROM picked GROUP BY video HAVING count_if(kind <> 'howto') < 1),
one AS (SELECT d.* FROM d JOIN few USING (video) WHERE kind <> 'howto' QUALIFY row_number() OVER (PARTITION BY video ORDER BY score DESC) = 1),
clear AS (SELECT d.* FROM d JOIN one USING (video) WHERE d.start >= one."end" + 5 OR d."end" + 5 <= one.start),
rest AS (SELECT video, ids FROM (SELECT video, 1 AS n, [event_id] AS ids, score AS total FROM clear UNION ALL SELECT a.video, 2, [a.event_id, b.event_id], a.score + b.score FROM clear a JOIN clear b ON a.video = b.video AND a."end" + 5 <= b.start)
  QUALIFY row_number() OVER (PARTITION BY video ORDER BY n DESC, total DESC) = 1)
SELECT video, event_id, start, "end", score FROM picked WHERE video NOT IN (SELECT video FROM one)
UNION ALL SELECT video, event_id, start, "end", score FROM one UNION ALL SELECT d.video, d.event_id, d.start, d."end", d.score FROM (SELECT video, unnest(ids) AS event_id FROM rest) JOIN d USING (video, event_id)""",
    "ema_path": f"""WITH RECURSIVE {v.SAMPLES}, {_SHOT}, m AS (SELECT user_id, shot, list_sort(list(x)) AS v FROM shots WHERE x IS NOT NULL GROUP BY 1, 2), a AS (SELECT user_id, shot, list_avg(list_filter(v, lambda y: abs(y - v[len(v) // 2 + 1]) <= 20)) AS anchor FROM m),
n AS (SELECT s.user_id, s.t, CASE WHEN x IS NOT NULL THEN least(greatest(anchor - 10, 0), 80) END AS aim, coalesce(lag(s.shot) OVER w <> s.shot, false) AS cut, coalesce(anchor, 50) - 10 AS start, row_number() OVER w AS rn FROM shots s LEFT JOIN a ON a.user_id = s.user_id AND a.shot = s.shot WINDOW w AS (PARTITION BY s.user_id ORDER BY s.t, s.event_id)),
k AS (SELECT user_id, 0::BIGINT AS rn, t, least(greatest(start, 0), 80)::DOUBLE AS now FROM n WHERE rn = 1
  UNION ALL SELECT user_id, rn, t, least(greatest(CASE WHEN cut THEN aim WHEN abs(aim - now) >= 6 THEN now + least(greatest(0.12::DOUBLE * (aim - now), -most), most) ELSE now END, 0), 80)
  FROM (SELECT n.user_id, n.rn, n.t, n.cut, coalesce(n.aim, k.now) AS aim, k.now, 18 * greatest(0.001::DOUBLE, n.t - k.t) AS most FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1))
SELECT user_id, t, round(now, 6) AS x FROM k WHERE rn > 0""",
    "speaker_pick": """WITH RECURSIVE e AS (SELECT user_id, event_id AS frame, floor(value * 100)::BIGINT AS v FROM events),
f AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS rn, list_sort(list_transform(range(frame % 4), lambda i: {'a': -((frame * (i + 3)) % 97), 'i': i, 'cx': ((v * (i + 1)) % 1000)::DOUBLE, 'e': ((v * (i + 2)) % 13)::DOUBLE})) AS f FROM e),
g AS (SELECT *, CASE WHEN len(f) = 1 THEN f[1].cx WHEN len(f) > 1 AND greatest(f[1].e, f[2].e) > 0 AND greatest(f[1].e, f[2].e) >= 2 * greatest(least(f[1].e, f[2].e), 1e-6) THEN CASE WHEN f[1].e >= f[2].e THEN f[1].cx ELSE f[2].cx END END AS sure FROM f),
k(user_id, rn, frame, now, last) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM g
  UNION ALL SELECT user_id, rn, frame, now, coalesce(now, last) FROM (SELECT g.user_id, g.rn, g.frame, k.last, CASE WHEN len(f) = 0 THEN NULL WHEN sure IS NOT NULL THEN sure WHEN k.last IS NULL THEN f[1].cx
    ELSE 0.65::DOUBLE * list_sort(list_transform(f, lambda x, i: {'d': abs(x.cx - k.last), 'i': i, 'cx': x.cx}))[1].cx + (1 - 0.65::DOUBLE) * k.last END AS now FROM k JOIN g ON g.user_id = k.user_id AND g.rn = k.rn + 1))
SELECT user_id, frame, round(now, 6) AS active FROM k WHERE rn > 0""",
    "dedupe_gap": f"""WITH RECURSIVE {v.SAMPLES}, n AS (SELECT user_id, event_id AS id, t, coalesce(floor(x), 0)::BIGINT AS votes, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM samples),
k AS (SELECT user_id, rn, id, t, votes, true AS added, 1::BIGINT AS place FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.rn, CASE WHEN n.t - k.t >= 86400 OR n.votes > k.votes THEN n.id ELSE k.id END, CASE WHEN n.t - k.t >= 86400 OR n.votes > k.votes THEN n.t ELSE k.t END, CASE WHEN n.t - k.t >= 86400 OR n.votes > k.votes THEN n.votes ELSE k.votes END,
    n.t - k.t >= 86400, k.place + CASE WHEN n.t - k.t >= 86400 THEN 1 ELSE 0 END FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1)
SELECT user_id, id, t, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id, place ORDER BY rn DESC) AS last FROM k) WHERE last = 1""",
    "travel": f"{_SA} SELECT user_id, round(sum(step), 6) AS travel, round(max(abs(x - 50)), 6) AS \"offset\" FROM (SELECT *, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS step FROM samples WHERE x IS NOT NULL) GROUP BY user_id",
    "running_min": f"{_SA} SELECT event_id, min(x) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS low FROM samples",
    "shot_from_diff": f"{_SA} SELECT user_id, count_if(c)::BIGINT AS cuts FROM (SELECT user_id, coalesce(abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY t, event_id)) > 28, false) AS c FROM samples WHERE x IS NOT NULL) GROUP BY user_id",
}

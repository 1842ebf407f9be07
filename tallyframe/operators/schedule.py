"""Selecting intervals under a count and a gap, with exploration and relaxed thresholds; and publish slots."""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import jitter_minutes
from ..sources.durable import stored
from .folds import cut_islands, folded


def best_by_count(start: list, end: list, score: list, k: int, gap: float) -> list[tuple[float, tuple]]:
    """For each count from 0 to at most k that so many intervals, at least `gap` apart, can reach: the best
    total and the intervals' numbers. Equal totals keep the intervals that end first."""
    n = len(start)
    order = sorted(range(n), key=lambda i: end[i])
    ends, best = [end[i] + gap for i in order], [[(0.0, ())]]
    for at, i in enumerate(order):
        before = best[min(bisect_right(ends, start[i]), at)]
        now = list(best[at])
        for c in range(min(k, len(before))):
            total = score[i] + before[c][0]
            if c + 1 == len(now):
                now.append((total, (i, before[c][1])))
            elif total > now[c + 1][0]:
                now[c + 1] = (total, (i, before[c][1]))
        best.append(now)

    def listed(chain: tuple) -> tuple:
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return tuple(out)

    return [(total, listed(chain)) for total, chain in best[n]]


#: Islands whose choices are merged in one step, before a group's blocks are.
BLOCK = 1024


def select_intervals(rows: DataFrame, by: list[str], key: str, k: str, gap: float) -> DataFrame:
    """(by, key) of the intervals (by, key, start, end, score, k) chosen in each group: as many as possible up
    to the group's k, at least `gap` apart, and of those the best total.

    A group is cut into islands where no interval and no gap reaches across. Each island is solved by
    itself for every count; the islands' totals by count are added as max-plus convolutions, by blocks
    of islands and then by group. What moves is at most k numbers and k keys a count, so a group of any
    size is worked by many tasks. Intervals with a null or NaN start, end or score are not eligible; repeated
    rows are intervals of their own; a k below 1 chooses none.
    """
    rows = rows.select(*by, key, *(F.col(c).cast("double").alias(c) for c in ("start", "end", "score")), F.col(k).cast("int").alias("k"))
    rows = rows.where((F.col("k") > 0) & reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in ("start", "end", "score"))))
    w = Window.partitionBy(*by).orderBy("start", "end", key)
    so_far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(so_far.isNull() | (F.col("start") >= so_far + gap), 1).otherwise(0))
    isles = marked.withColumn("island", F.sum("_new").over(w)).drop("_new")
    types = dict(rows.dtypes)
    head, keyed = ", ".join(f"{c} {types[c]}" for c in by), f"keys array<{types[key]}>"
    one = F.count("*").over(Window.partitionBy(*by, "island")) == 1
    isles = isles.withColumn("alone", one)
    n = len(by)

    def add(state: list, row: tuple):
        state.append(row)
        return ()

    def solved(state: list):
        pick = lambda i: [r[i] for r in state]
        group, own = state[0][: n + 1], pick(n + 1)
        for c, (total, chosen) in enumerate(best_by_count(pick(n + 2), pick(n + 3), pick(n + 4), state[0][n + 5], gap)):
            if c:
                yield (*group, c, total, [own[i] for i in chosen], state[0][n + 5])

    schema = f"{head}, island long, c int, total double, {keyed}, k int"
    many = folded(isles.where("not alone").select(*by, "island", key, "start", "end", "score", "k"), [*by, "island"], ["start", "end", key], list, add, solved, schema)
    single = isles.where("alone").select(*by, "island", F.lit(1).alias("c"), F.col("score").alias("total"), F.array(key).alias("keys"), "k")

    def merged(answers: DataFrame, keys: list[str], order: str, last: bool) -> DataFrame:
        m = len(keys)

        def close(state: dict) -> list:
            """best, convolved with the island's own answers."""
            best, own = state["best"], state["own"]
            out = list(best)
            for c, (total, chosen) in own.items():
                for b, (had, with_) in enumerate(best):
                    if b + c <= state["k"]:
                        while len(out) <= b + c:
                            out.append(None)
                        if out[b + c] is None or had + total > out[b + c][0]:
                            out[b + c] = (had + total, [*with_, *chosen])
            return out

        def step(state: dict, row: tuple):
            place = row[m]
            if state.get("at") != place:
                if "at" in state:
                    state["best"] = close(state)
                state |= {"at": place, "own": {}, "key": row[:m], "k": row[m + 4]}
                state.setdefault("best", [(0.0, [])])
            state["own"][row[m + 1]] = (row[m + 2], list(row[m + 3]))
            return ()

        def end(state: dict):
            best = close(state)
            for c, (total, chosen) in enumerate(best):
                if c and (not last or c == len(best) - 1):
                    yield (*state["key"], c, total, chosen, state["k"])

        more = ", ".join(f"{c} {types.get(c, 'long')}" for c in keys)
        return folded(answers.select(*keys, order, "c", "total", "keys", "k"), keys, [order, "c"], dict, step, end, f"{more}, c int, total double, {keyed}, k int")

    answers = many.unionByName(single).withColumn("block", F.floor(F.col("island") / BLOCK))
    blocks = merged(answers, [*by, "block"], "island", False)
    return merged(blocks, by, "block", True).select(*by, F.explode("keys").alias(key))


def schedule(rows: DataFrame, by: str, key: str, k: int, gap: float, kind: str | None = None, exploited: frozenset = frozenset(), thresholds: tuple[float, ...] = (), ratio: float = 0.2) -> DataFrame:
    """(by, key, start, end, score, threshold) of the chosen intervals of each group. key names an interval.

    thresholds: scores from which intervals are eligible, tried in order until k are chosen; the
    last holds in any case. kind, exploited: where fewer than a share of k, rounded up, are of other
    kinds than the exploited, the best of those are chosen first and the rest around them.
    """
    tries = thresholds or (float("-inf"),)
    own = rows.select(by, key, "start", "end", "score", *([kind] if kind else []))
    level = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(low).alias("threshold")) for i, low in enumerate(tries)))).alias("x")
    pools = own.select("*", level).select(*own.columns, "x.t", "x.threshold").where(F.col("score") >= F.col("threshold")).withColumn("k", F.lit(k))
    picked = stored(select_intervals(pools, [by, "t"], key, "k", gap))
    counts = picked.groupBy(by, "t").agg(F.count("*").alias("n"))
    enough = counts.groupBy(F.col(by).alias("c_by")).agg(F.coalesce(F.min(F.when(F.col("n") >= k, F.col("t"))), F.lit(len(tries) - 1)).alias("c_t"))
    taken = picked.join(enough, picked[by].eqNullSafe(F.col("c_by")) & (F.col("t") == F.col("c_t")), "left_semi")
    full = pools.withColumnRenamed(by, "p_by").withColumnRenamed("t", "p_t").withColumnRenamed(key, "p_key")
    out = taken.join(full, taken[by].eqNullSafe(full["p_by"]) & (taken["t"] == full["p_t"]) & taken[key].eqNullSafe(full["p_key"])).select(by, key, "start", "end", "score", *([kind] if kind else []), "threshold")
    if kind and exploited and k > 0:
        out = _explored(stored(out), pools, enough, by, key, k, gap, kind, exploited, max(1, math.ceil(ratio * k)))
    return out.select(by, key, *(F.col(c).cast("double").alias(c) for c in ("start", "end", "score")), "threshold")


def _explored(out: DataFrame, pools: DataFrame, enough: DataFrame, by: str, key: str, k: int, gap: float, kind: str, exploited: frozenset, quota: int) -> DataFrame:
    other = ~F.coalesce(F.col(kind).isin(*exploited), F.lit(False))
    few = out.groupBy(F.col(by).alias("f_by")).agg(F.count_if(other).alias("others")).where(F.col("others") < quota).select("f_by")
    pool = pools.join(enough, pools[by].eqNullSafe(F.col("c_by")) & (pools["t"] == F.col("c_t")), "left_semi").join(few, pools[by].eqNullSafe(F.col("f_by")), "left_semi")
    pool = stored(pool.select(by, key, "start", "end", "score", kind, "threshold"))
    names = select_intervals(pool.where(other).withColumn("k", F.lit(quota)), [by], key, "k", gap)
    first = stored(pool.join(names.select(F.col(by).alias("n_by"), F.col(key).alias("n_key")), pool[by].eqNullSafe(F.col("n_by")) & pool[key].eqNullSafe(F.col("n_key")), "left_semi"))
    left = first.groupBy(F.col(by).alias("l_by")).agg((F.lit(k) - F.count("*")).cast("int").alias("k"))
    clear = without_conflicts(pool, first, by, gap)
    clear = clear.join(left, clear[by].eqNullSafe(F.col("l_by"))).drop("l_by")
    names = select_intervals(clear, [by], key, "k", gap)
    second = pool.join(names.select(F.col(by).alias("n_by"), F.col(key).alias("n_key")), pool[by].eqNullSafe(F.col("n_by")) & pool[key].eqNullSafe(F.col("n_key")), "left_semi")
    kept = out.join(left.select("l_by"), out[by].eqNullSafe(F.col("l_by")), "left_anti")
    return kept.unionByName(first).unionByName(second)


def greedy_with_quota(rows: DataFrame, by: str, n: int, multiplier: Column, top: tuple[str, ...], ratio: float = 0.2) -> DataFrame:
    """The best by adjusted score, a quota of other kinds than `top`, then the next best: with the reason."""
    quota = max(1, math.ceil(ratio * n)) if n > 1 else 0
    r = rows.withColumn("adjusted", F.col("score") * multiplier)
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("adjusted"), "id")))
    r = r.withColumn("greedy", F.col("rn") <= n - quota).withColumn("other", ~F.col("greedy") & ~F.col("hook_type").isin(*top))
    r = r.withColumn("on", F.row_number().over(Window.partitionBy(by, "other").orderBy("rn")))
    r = r.withColumn("quota", F.col("other") & (F.col("on") <= quota)).withColumn("taken", F.col("greedy") | F.col("quota"))
    r = r.withColumn("spare", F.lit(n) - F.count_if("taken").over(Window.partitionBy(by))).withColumn("fn", F.row_number().over(Window.partitionBy(by, "taken").orderBy("rn")))
    reason = F.when(F.col("greedy"), "greedy").when(F.col("quota"), "exploration_quota").when(F.col("fn") <= F.col("spare"), "greedy_fill")
    return r.withColumn("selected_reason", reason).where("selected_reason is not null").select(*rows.columns, "selected_reason")


#: Publish rules (id, platform, weekdays from Monday 0, minute of day, until, weight).
RULES = (
    ("S1", "linkedin", (1, 2, 3), 480, 555, 1.0), ("S2", "linkedin", (1, 2, 3), 750, 810, 0.8), ("S3", "instagram", (0, 1, 2, 3, 4, 5, 6), 1200, 1350, 1.0), ("S4", "instagram", (0, 1, 2, 3, 4), 720, 810, 0.75),
    ("S5", "x", (0, 1, 2, 3, 4), 540, 600, 1.0), ("S6", "x", (0, 1, 2, 3, 4), 1260, 1350, 0.8), ("S7", "tiktok", (2, 3, 4, 5, 6), 1140, 1350, 1.0), ("S8", "youtube", (0, 1, 2, 3, 4, 5, 6), 1080, 1260, 1.0),
)
#: What a hook type adds before and after 15:00.
CONTENT = {"data_number": (0.15, 0.0), "contrarian": (0.0, 0.15), "howto": (0.05, 0.05), "story": (0.0, 0.10), "question": (0.10, 0.05)}
#: Public holidays (month, day); gaps in hours and minutes; offset of local time.
HOLIDAYS = ((1, 1), (4, 23), (5, 1), (5, 19), (7, 15), (8, 30), (10, 29))
MIN_GAP_H, STAGGER_MIN, LOCAL = 4, 30, "+03:00"


def is_holiday(ts: Column) -> Column:
    return (F.month(ts) * 100 + F.dayofmonth(ts)).isin(*(m * 100 + d for m, d in HOLIDAYS))


def _slots(days: int) -> Column:
    """Array of a post's (day, rule, slot, score): a row's slots, without an exchange. The rules are
    eight rows, built into the plan."""
    kinds = "array<struct<day:int,rule:string,minute:int,weight:double,weekdays:array<int>>>"

    def pairs(rules) -> Column:
        """Every day of every rule, as one literal: day by day, the rules in their order."""
        return F.array(*(F.struct(F.lit(day), F.lit(i), F.lit(a), F.lit(float(x)), F.array(*map(F.lit, w))) for day in range(days) for i, w, a, x in rules)).cast(kinds)

    own = pairs([("S0", (1, 2, 3), 600, 0.5)])
    for platform in dict.fromkeys(r[1] for r in RULES):
        own = F.when(F.col("platform") == platform, pairs([(i, w, a, x) for i, p, w, a, _, x in RULES if p == platform])).otherwise(own)
    today, first = F.weekday("now"), F.date_trunc("day", "now")
    meant = F.filter(own, lambda x: F.array_contains(x["weekdays"], (today + x["day"]) % 7))  # before any time is worked out

    def at(x: Column) -> Column:
        slot = F.timestamp_add("MINUTE", x["minute"], F.timestamp_add("DAY", x["day"], first))
        return F.struct(x["day"].alias("day"), x["rule"].alias("rule"), slot.alias("slot"), x["weight"].alias("weight"))

    open_ = F.filter(F.transform(meant, at), lambda x: x["slot"] > F.timestamp_add("MINUTE", F.lit(30), F.col("now")))

    def bonus(x: Column) -> Column:
        return F.coalesce(*(F.when(F.col("hook_type") == h, F.when(F.hour(x["slot"]) < 15, a).otherwise(b)) for h, (a, b) in CONTENT.items()), F.lit(0.0))

    return F.transform(open_, lambda x: F.struct(x["day"].alias("day"), x["rule"].alias("rule"), x["slot"].alias("slot"), (x["weight"] + bonus(x) - x["day"] * 0.02).alias("score")))


def slot_candidates(posts: DataFrame, days: int = 7, observed: DataFrame | None = None) -> DataFrame:
    """Each post's slots (columns post_id, platform, hook_type, now in local time): day, rule, slot, score.

    observed: (platform, weekday, hour, lift, n), which adds to the score in proportion to n / (n + 20).
    """
    s = posts.select("post_id", "platform", "hook_type", F.explode(_slots(days)).alias("s")).select("post_id", "platform", "hook_type", "s.*")
    score = F.col("score")
    if observed is not None:
        o = observed.select(F.col("platform").alias("o_p"), F.col("weekday").alias("o_w"), F.col("hour").alias("o_h"), "lift", "n")
        s = s.join(o, (F.col("platform") == F.col("o_p")) & (F.weekday("slot") == F.col("o_w")) & (F.hour("slot") == F.col("o_h")), "left")
        score = score + F.coalesce(F.col("lift") * F.col("n") / (F.col("n") + 20), F.lit(0.0))
    return s.select("post_id", "platform", "hook_type", "day", "rule", F.col("slot").cast("timestamp_ntz").alias("slot"), F.round(score, 4).alias("score"))


def best_slots(posts: DataFrame, first: int, last: int, days: int = 7) -> DataFrame:
    """(post_id, rule, slot, score, rn): each post's slots from the first-th to the last-th best, ranked
    within its row; equal scores go by day and rule."""
    order = F.array_sort(F.transform(_slots(days), lambda x: F.struct((-F.round(x["score"], 4)).alias("low"), x["day"].alias("day"), x["rule"].alias("rule"), x["slot"].alias("slot"))))
    some = posts.select("post_id", F.posexplode(F.slice(order, first, last - first + 1)).alias("at", "x"))
    return some.select("post_id", "x.rule", F.col("x.slot").cast("timestamp_ntz").alias("slot"), (-F.col("x.low")).alias("score"), (F.col("at") + first).alias("rn"))


#: The notes of a plan.
NO_RULE, HOLIDAY_SKIPPED, RELAXED, STAGGERED, JITTERED = "no_rule_matched", "G3_holiday_skipped", "G1_relaxed_no_free_slot", "G2_cross_platform_stagger", "G5_jitter_applied"


#: A post's time is its slot's, later by STAGGER_MIN or not, moved by up to JITTER minutes.
JITTER, DAY = 12, 1440
_MINUTES = {i: a for i, _, _, a, _, _ in RULES} | {"S0": 600}


def _reached() -> dict[str, list[int]]:
    """For each rule, how many minutes from its slots others of its platform lie that a post there may block."""
    of = {r[0]: r[1] for r in RULES}
    apart = {x: [_MINUTES[y] - a + day * DAY for y in _MINUTES for day in (-1, 0, 1) if of.get(x) == of.get(y) and (y != x or day)] for x, a in _MINUTES.items()}
    return {x: [d for d in far if -JITTER - MIN_GAP_H * 60 < d < STAGGER_MIN + JITTER + MIN_GAP_H * 60] for x, far in apart.items()}


def _staggers_that_tell() -> set[str]:
    """Rules at whose slots it depends on the stagger what a post blocks, and those whose posts may stagger such a one."""
    blocks = lambda d, off: abs(d - off) < MIN_GAP_H * 60
    found = {x for x, far in _reached().items() for d in far if any(blocks(d, j) != blocks(d, j + STAGGER_MIN) for j in range(-JITTER, JITTER + 1))}
    while more := {y for y, b in _MINUTES.items() for x in found for day in (-1, 0, 1) if -STAGGER_MIN - JITTER - STAGGER_MIN < b + day * DAY - _MINUTES[x] < STAGGER_MIN + JITTER} - found:
        found |= more
    return found


class Taken:
    """Planned minutes, as the first and last in each stretch of `gap` minutes: that tells whether one is nearer than the gap."""

    def __init__(self, gap: int) -> None:
        self.gap, self.ends = gap, {}

    def add(self, at: int) -> None:
        first, last = self.ends.get(at // self.gap, (at, at))
        self.ends[at // self.gap] = min(first, at), max(last, at)

    def near(self, at: int) -> bool:
        k, none = at // self.gap, (float("-inf"), float("inf"))
        return k in self.ends or self.ends.get(k - 1, none[:1])[-1] > at - self.gap or self.ends.get(k + 1, none[1:])[0] < at + self.gap


class Planned:
    """What limits a video's next post: minutes planned so far, by platform and by clip."""

    def __init__(self) -> None:
        self.platforms: dict[str, Taken] = {}
        self.clips: dict[str | None, Taken] = {}

    def choose(self, platform: str, clip: str | None, shared: bool, choices: list[int], jitter: int) -> tuple[int, int, bool]:
        """(place of its slot, free holidays skipped, whether none was free) of the post, which is added to what
        is planned. choices: from the best on twice a slot's minute, and one for a holiday. Clips are looked at if shared."""
        taken, pick, skipped = self.platforms.setdefault(platform, Taken(MIN_GAP_H * 60)), None, 0
        for place, x in enumerate(choices):
            if not taken.near(x >> 1):
                if not x & 1:
                    pick = place
                    break
                skipped += 1
        at = choices[pick or 0] >> 1
        if shared:
            own = self.clips.setdefault(clip, Taken(STAGGER_MIN))
            at += STAGGER_MIN * own.near(at) + jitter
            own.add(at)
        else:
            at += jitter
        taken.add(at)
        return pick or 0, skipped, pick is None


def _since() -> Column:
    """Seconds of the last moment up to now from which a post's slots are the same: midnight, or when one gets too near."""
    first = F.date_trunc("day", "now")
    last = F.lit(None).cast("timestamp")
    for platform in dict.fromkeys(r[1] for r in RULES):
        cuts = [F.timestamp_add("MINUTE", F.lit(a - 30), first) for _, p, _, a, _, _ in RULES if p == platform]
        last = F.when(F.col("platform") == platform, F.greatest(first, *(F.when(c <= F.col("now"), c) for c in cuts))).otherwise(last)
    other = F.timestamp_add("MINUTE", F.lit(_MINUTES["S0"] - 30), first)
    return F.unix_seconds(F.coalesce(last, F.when(other <= F.col("now"), other), first).cast("timestamp"))


def plan_slots(posts: DataFrame, by: str, clip: str, days: int = 7) -> DataFrame:
    """(by, post_id, clip, platform, rule, slot, score, constraints): one publish time per post of (by, clip,
    post_id, platform, hook_type, now), in order of post_id within `by`.

    A post takes its best slot that is no holiday and at least MIN_GAP_H hours from the posts already
    planned for its platform, whatever their clip; if none is free, its best. Within STAGGER_MIN minutes
    of another post of its clip it goes that much later; its jitter comes last.

    Slots are worked out once for all posts of a platform and hook type that have the same. A slot that is taken stays
    taken, and a post that finds one free takes one. So of a video's posts of a platform with the same n slots,
    those behind the first n find none and take their best, which nobody else notices if no slot is a
    holiday: they need no fold. The others are folded by video and islands of time (posts more than days + 2 days
    apart cannot limit each other), as many as there are slots at most, and those with holidays. The stagger comes
    behind: a clip's posts that are planned far from its others go as they are, the rest is folded by clip and island.
    Where it depends on the stagger what a post blocks, the first fold sees the clip's other posts of that kind too.

    Defined cases: a post without a time or platform takes tomorrow at nine and neither limits nor is
    limited; repeated rows are posts of their own; a null video or clip is one of its own; an empty table
    gives none.
    """
    types, reached, telling = dict(posts.dtypes), _reached(), _staggers_that_tell()
    minute = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / 60_000_000)
    rows = stored(posts.select(by, clip, "post_id", "platform", "hook_type", "now").withColumn("since", _since()).withColumn("jitter", jitter_minutes(F.col("post_id").cast("string"))).drop("now"))
    known = F.col("platform").isNotNull() & F.col("since").isNotNull()

    order = F.array_sort(F.transform(_slots(days), lambda x: F.struct((-F.round(x["score"], 4)).alias("low"), x["day"].alias("day"), x["rule"].alias("rule"), x["slot"].cast("timestamp_ntz").alias("slot"))))
    slots = F.transform(order, lambda x: F.struct(x["rule"].alias("rule"), minute(x["slot"]).alias("minute"), (-x["low"]).alias("score"), is_holiday(x["slot"]).alias("holiday")))
    kinds = rows.where(known).select("platform", "hook_type", "since").distinct().withColumn("now", F.timestamp_seconds("since").cast(types["now"])).withColumn("slots", slots)
    best, minutes = F.get("slots", F.lit(0)), F.transform("slots", lambda x: x["minute"])
    alone = reduce(lambda a, b: a & b, (F.when(best["rule"] == x, F.array_contains(minutes, best["minute"] + d)).otherwise(True) for x, far in reached.items() for d in far), ~F.exists("slots", lambda x: x["holiday"]))
    kinds = kinds.select("platform", "hook_type", "since", F.monotonically_increasing_id().alias("kind"), "slots", F.size("slots").alias("n"), alone.alias("settled"), F.exists("slots", lambda x: x["rule"].isin(*telling) if telling else F.lit(False)).alias("telling"))
    kinds = stored(kinds.withColumn("best", best))

    w = Window.partitionBy(by, "platform", "since").orderBy("post_id", clip, "hook_type")
    ranked = rows.where(known).withColumn("rn", F.row_number().over(w))
    k = kinds.select(F.col("platform").alias("k_platform"), F.col("hook_type").alias("k_hook"), F.col("since").alias("k_since"), "kind", "n", "settled", "telling", "best.rule", "best.minute", "best.score")
    ranked = ranked.join(k, (F.col("platform") == F.col("k_platform")) & (F.col("since") == F.col("k_since")) & F.col("hook_type").eqNullSafe(F.col("k_hook")))
    ranked = stored(ranked.withColumn("folds", (F.col("rn") <= F.col("n")) | ~F.col("settled")).drop("k_platform", "k_hook", "k_since", "rn", "settled"))

    ready = F.col("n") > 0
    in_clip = Window.partitionBy(by, clip).orderBy("since")
    reach = F.lit((days + 2) * 86400)
    close = lambda c: F.coalesce(F.abs(c - F.col("since")) <= reach, F.lit(False))
    some = ranked.where(ready & F.col("telling")).withColumn("shared", close(F.lag("since").over(in_clip)) | close(F.lead("since").over(in_clip))).where(F.col("folds") | F.col("shared"))
    some = some.unionByName(ranked.where(ready & ~F.col("telling") & F.col("folds")).withColumn("shared", F.lit(False)))
    choices = kinds.select(F.col("kind").alias("k_kind"), F.transform("slots", lambda x: x["minute"] * 2 + x["holiday"].cast("long")).alias("choices"))
    some = cut_islands(some.select(by, clip, "post_id", "platform", "hook_type", "since", "jitter", "kind", "shared", "folds"), by, F.col("since") / 86400.0, days + 2.0)
    some = some.join(choices, F.col("kind") == F.col("k_kind"))
    some = some.select(by, "island", "post_id", clip, "platform", "hook_type", "since", "jitter", "kind", "shared", "folds", F.col(clip).cast("string").alias("name"), "choices")

    def step(state: Planned, row: tuple):
        video, _, post, own, platform, hook, since, jitter, kind, shared, folds, name, choices = row
        place, skipped, relaxed = state.choose(platform, name, shared, choices.tolist(), jitter)
        if folds:
            yield video, post, own, platform, hook, since, jitter, kind, place, skipped, relaxed

    head = f"{by} {types[by]}, post_id {types['post_id']}, {clip} {types[clip]}, platform string, hook_type string, since long, jitter int"
    chosen = folded(some, [by, "island"], ["post_id", clip, "platform", "since", "hook_type"], Planned, step, lambda _: (), f"{head}, kind long, place int, skipped int, relaxed boolean")
    chosen = chosen.join(kinds.select(F.col("kind").alias("k_kind"), "slots"), F.col("kind") == F.col("k_kind")).withColumn("x", F.get("slots", F.col("place")))
    columns = (by, "post_id", clip, "platform", "hook_type", "since", "jitter")
    chosen = chosen.select(*columns, "x.rule", "x.minute", "x.score", "skipped", "relaxed")
    others = ranked.where(ready & ~F.col("folds")).select(*columns, "rule", "minute", "score", F.lit(0).alias("skipped"), F.lit(True).alias("relaxed"))

    w = Window.partitionBy(by, clip).orderBy("minute")
    far = lambda c: F.coalesce(F.abs(F.col("minute") - c) >= 2 * (STAGGER_MIN + JITTER), F.lit(True))
    planned = chosen.unionByName(others).withColumn("first", far(F.lag("minute").over(w))).withColumn("alone", F.col("first") & far(F.lead("minute").over(w)))
    planned = stored(planned.withColumn("island", F.sum(F.col("first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("first"))

    def stagger(state: Taken, row: tuple):
        video, own, _, post, platform, _, _, jitter, rule, at, score, skipped, relaxed = row
        late = state.near(at)
        at += STAGGER_MIN * late + jitter
        state.add(at)
        yield video, post, own, platform, rule, at, score, skipped, relaxed, late

    head = f"{by} {types[by]}, post_id {types['post_id']}, {clip} {types[clip]}, platform string"
    close = planned.where(~F.col("alone")).select(by, clip, "island", "post_id", "platform", "hook_type", "since", "jitter", "rule", "minute", "score", "skipped", "relaxed")
    late = folded(close, [by, clip, "island"], ["post_id", "platform", "since", "hook_type"], lambda: Taken(STAGGER_MIN), stagger, lambda _: (), f"{head}, rule string, minute long, score double, skipped int, relaxed boolean, late boolean")
    done = planned.where("alone").select(by, "post_id", clip, "platform", "rule", (F.col("minute") + F.col("jitter")).alias("minute"), "score", "skipped", "relaxed", F.lit(False).alias("late")).unionByName(late)
    notes = F.concat_ws(",", F.array_repeat(F.lit(HOLIDAY_SKIPPED), F.col("skipped")), F.when(F.col("relaxed"), RELAXED), F.when(F.col("late"), STAGGERED), F.lit(JITTERED))
    done = done.select(by, "post_id", clip, "platform", "rule", "minute", "score", notes.alias("constraints"))
    none = rows.where(~known).select(*columns).unionByName(ranked.where(~ready).select(*columns))
    at = F.date_trunc("day", F.timestamp_add("DAY", F.lit(1), F.timestamp_seconds("since"))) + F.expr("INTERVAL 9 HOURS")
    none = none.select(by, "post_id", clip, "platform", F.lit("FALLBACK").alias("rule"), minute(at).alias("minute"), F.lit(0.0).alias("score"), F.lit(NO_RULE).alias("constraints"))
    slot = F.timestamp_seconds(F.col("minute") * 60).cast("timestamp_ntz")
    return done.unionByName(none).select(by, "post_id", clip, "platform", "rule", slot.alias("slot"), "score", "constraints")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, gap: float) -> Column:
    return (a_start < b_end + gap) & (b_start < a_end + gap)


def without_conflicts(rows: DataFrame, chosen: DataFrame, by: str, gap: float, bucket_s: float = 3600.0) -> DataFrame:
    """Rows that overlap no chosen interval of their group. Both sides are cut into time buckets, so
    the join is by group and bucket with the overlap as its residue, not by all pairs of a group.
    Nulls: a row without a group, start or end overlaps nothing; other columns may hold any."""
    span = lambda s, e: F.sequence(F.floor(s / bucket_s), F.floor(e / bucket_s))
    c = chosen.select(F.col(by).alias("c_by"), F.col("start").alias("c_start"), F.col("end").alias("c_end")).withColumn("c_bucket", F.explode(span(F.col("c_start") - gap, F.col("c_end") + gap)))
    r = rows.withColumn("_bucket", F.explode(span(F.col("start"), F.col("end"))))
    found = r.join(c, (F.col(by) == F.col("c_by")) & (F.col("_bucket") == F.col("c_bucket")) & overlaps(F.col("start"), F.col("end"), F.col("c_start"), F.col("c_end"), gap), "left_semi")
    hit = found.select(*(F.col(c).alias(f"h_{c}") for c in rows.columns)).distinct()
    return rows.join(hit, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in rows.columns)), "left_anti")

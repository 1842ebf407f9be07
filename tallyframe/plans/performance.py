"""Queries on posts and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import performance as perf
from ..operators import priors, ranks, store
from . import views as v

M = list(perf.WEIGHTS)
R = lambda c, n=6: F.round(c, n).alias(c)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return perf.composite(perf.zscores(v.outcomes(spark, d)))


def detail(rows: DataFrame) -> DataFrame:
    """Adds provenance by field, made from the row's flag: R all real, A half, N simulated."""
    first = F.when(F.col("flag").isin("R", "A"), "REAL").otherwise("SIMULATED")
    second = F.when(F.col("flag") == "R", "REAL").otherwise("SIMULATED")
    pairs = [x for i, m in enumerate(M) for x in (F.lit(m), first if i % 2 == 0 else second)]
    return rows.withColumn("detail", F.create_map(*pairs))


def aged(spark, d):
    """Outcomes that may teach, with their age in days before the newest."""
    rows = detail(scored(spark, d))
    newest = v.metrics(spark, d, 1).join(v.posts(spark, d), "post_id", "left_semi").agg(F.max("collected_at").alias("newest"))
    age = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("collected_at").cast("timestamp"))) / 86400e6
    return rows.crossJoin(F.broadcast(newest)).withColumn("age_days", age)  # one row


def outcomes_join(s, d):
    return v.outcomes(s, d).select("post_id", "clip_id", "platform", "hook_type", "window", *M)


def zscore_platform(s, d):
    return perf.zscores(v.outcomes(s, d)).select("post_id", *(R(f"z_{m}") for m in M))


def hqs_composite(s, d):
    return scored(s, d).select("post_id", R("hqs", 5))


def hook_ranking(s, d):
    return perf.shrunk_ranking(scored(s, d))


def hook_gap_drivers(s, d):
    rows = scored(s, d)
    return perf.gap_drivers(rows, perf.shrunk_ranking(rows))


def ab_lift_by_platform(s, d):
    out = perf.ab_lifts(v.outcomes(s, d))
    return out.select("ab_group", "platform", "n_a", "n_b", *(perf.half_up(F.col(c), n).alias(c) for c, n in [*((f"lift_{m}", 5) for m in M), ("composite_lift", 3)]))


def ab_verdict(s, d):
    return perf.ab_verdicts(perf.ab_lifts(v.outcomes(s, d))).withColumn("mean_lift", perf.half_up(F.col("exact_lift"), 3)).drop("exact_lift")


def provenance_rollup(s, d):
    return detail(v.outcomes(s, d)).select("post_id", perf.row_provenance(F.col("detail")).alias("provenance"))


def simulated_share(s, d):
    rows = detail(v.outcomes(s, d))
    return rows.groupBy("hook_type").agg(F.round(1 - F.avg(perf.real_fraction(F.col("detail"))), 6).alias("simulated_share"), F.count_if(perf.real_weight(F.col("detail")) >= perf.TEACHING).alias("teaching"))


def real_weight(s, d):
    return detail(v.outcomes(s, d)).select("post_id", F.round(perf.real_weight(F.col("detail")), 6).alias("real_weight"))


def hook_priors(s, d):
    rows = aged(s, d)
    taught = rows.where(perf.real_weight(F.col("detail")) >= perf.TEACHING)
    return priors.hook_priors(taught, v.outcomes(s, d).select("hook_type")).drop("sampled_multiplier")


def hook_priors_sampled(s, d):
    rows = aged(s, d)
    taught = rows.where(perf.real_weight(F.col("detail")) >= perf.TEACHING)
    return priors.hook_priors(taught, v.outcomes(s, d).select("hook_type"), seed="run").select("hook_type", R("sampled_multiplier", 3))


def newest_snapshot(s, d):
    rows = v.metrics(s, d).select("post_id", "window", "collected_at", "ctr")
    return store.newest(rows, "post_id", "collected_at", "window")


def upsert_converges(s, d):
    old = v.metrics(s, d, 1, 2).select("post_id", "window", "hook_retention_3s", "ctr")
    new = v.metrics(s, d, 2, 3).select("post_id", "window", (F.col("ctr") + 1).alias("ctr"), F.lit(1).alias("at"))
    return store.upsert(old, new, ["post_id", "window"], "at").select("post_id", "window", "hook_retention_3s", R("ctr"))


def left_join_default(s, d):
    m = v.metrics(s, d, 2).select("post_id", "ctr", "flag")
    return store.left_with_defaults(v.posts(s, d).select("post_id", "platform"), m, "post_id", {"ctr": 0.0, "flag": "none"})


def anti_accounting(s, d):
    """Every post, with what became of it: those without metrics are counted, not lost."""
    m = v.metrics(s, d, 7).select(F.col("post_id").alias("m_id"))
    return v.posts(s, d).join(m, F.col("post_id") == F.col("m_id"), "left").select("post_id", F.when(F.col("m_id").isNull(), "skipped_no_metrics").otherwise("ok").alias("outcome"))


def fallback_key_join(s, d):
    p = v.posts(s, d)
    by_post = p.where("post_id % 10 = 0").select(F.col("post_id").cast("string").alias("key"), F.lit(None).cast("string").alias("platform"), F.lit("post").alias("remote_id"))
    by_clip = p.where("clip_id % 7 = 0").groupBy(F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("key")).agg(F.min("platform").alias("platform"), F.lit("clip").alias("remote_id"))
    left = p.select("post_id", F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("clip_key"), "platform")
    return store.fallback_join(left, by_post.unionByName(by_clip), "post_id", "clip_key", "platform", "remote_id").select("post_id", "platform", "remote_id")


def posts_x_windows(s, d):
    days = F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.lit(n).alias("days")) for w, n in (("T+1h", 0), ("T+24h", 1), ("T+7d", 7), ("T+30d", 30))))).alias("x")
    return v.posts(s, d).select("post_id", days).select("post_id", "x.window", "x.days")


def target_window_fallback(s, d):
    return store.target_or_last(v.metrics(s, d), "post_id", "window", "w2").select("post_id", "window", "ctr")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def store_counts(s, d):
    return store.counts({t: v.table(s, d, t) for t in TABLES})


def minmax_gate_pick(s, d):
    """Best candidate of each post: metrics scaled within the post (flat: 0.5), weighted, gated."""
    m = v.metrics(s, d)
    w = Window.partitionBy("post_id")

    def scaled(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi - lo <= 1e-9, 0.5).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))

    gate = F.when(F.col("flag") == "N", 0.25).otherwise(1.0)
    rated = m.withColumn("score", F.round((0.6 * scaled("completion_rate") + 0.4 * scaled("hook_retention_3s")) * gate, 6))
    return rated.groupBy("post_id").agg(F.max_by("window", F.struct("score", F.expr("-ascii(substr(window, 2))"))).alias("window"), F.max("score").alias("score"))


def criteria_long(s, d):
    m = v.metrics(s, d)
    return m.unpivot(["post_id", "window"], M, "criterion", "raw")


def derived_keys(s, d):
    return v.metrics(s, d).select("post_id", "window", F.concat_ws("|", F.col("post_id").cast("string"), "window").alias("metric_id"))


def status_filter(s, d):
    return v.posts(s, d).where("status = 'F' and total >= 150000").select("post_id", "status", R("total", 2))


def membership_semi(s, d):
    good = v.table(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("clip_id"))
    return v.posts(s, d).join(good, "clip_id", "left_semi").select("post_id", "clip_id")


def classify_case(s, d):
    """First rule that holds names the row."""
    label = F.when(F.col("ctr") >= 0.08, "high").when((F.col("ctr") >= 0.04) & (F.col("flag") == "N"), "fresh").when(F.col("ctr") >= 0.04, "mid").otherwise("low")
    return v.metrics(s, d).select("post_id", "window", label.alias("label"))


def issue_rows(s, d):
    found = store.issues((F.col("total") > 300000, "too_large", "error"), (F.col("status") == "P", "pending", "warning"), (F.col("platform").startswith("4"), "unspecified", "info"))
    return v.posts(s, d).select("post_id", F.explode(found).alias("i")).select("post_id", "i.code", "i.severity")


def inner_skip(s, d):
    return v.posts(s, d).join(v.metrics(s, d, 7), "post_id").select("post_id", "hook_type", "ctr")


def dim_lookup_default(s, d):
    dim = s.createDataFrame([("1-URGENT", 0.18), ("2-HIGH", 0.55), ("3-MEDIUM", 0.85)], "platform string, maturity double")
    return store.left_with_defaults(v.posts(s, d).select("post_id", "platform"), F.broadcast(dim), "platform", {"maturity": 0.6})  # three rows


def group_stats(s, d):
    return v.outcomes(s, d).groupBy("hook_type").agg(F.count("*").alias("n"), F.round(F.avg("ctr"), 6).alias("mean"), F.max("ctr").alias("top"), F.min("ctr").alias("low")).orderBy("hook_type")


def percentiles(s, d):
    g = v.outcomes(s, d).groupBy("platform").agg(F.round(F.expr("percentile(completion_rate, 0.95)"), 6).alias("p95"), F.round(F.median("completion_rate"), 6).alias("mid"))
    return g.withColumn("spread", F.round(F.col("p95") - F.col("mid"), 5))


def distinct_sets(s, d):
    return v.posts(s, d).groupBy("hook_type").agg(F.count_distinct("platform").alias("platforms"), F.count_distinct("clip_id").alias("clips"))


def rubric_total(s, d):
    """Sum of weighted scores over the criteria's long rows, times the hook type's learned multiplier."""
    weight = F.element_at(F.create_map(*(F.lit(x) for m, w in perf.WEIGHTS.items() for x in (m, w * 100))), F.col("criterion"))
    long = v.outcomes(s, d).unpivot(["post_id", "hook_type"], M, "criterion", "raw").select("post_id", "hook_type", F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("raw") * 10)) / 10 * weight, 4).alias("weighted"))
    base = long.groupBy("post_id", "hook_type").agg(F.sum("weighted").alias("base"))
    return store.left_with_defaults(base, hook_priors(s, d), "hook_type", {"multiplier": 1.0}).select("post_id", R("base", 3), F.round(F.col("base") * F.col("multiplier"), 2).alias("total"))


def rubric_twelve(s, d):
    """The whole rubric on made-up scores, some of them missing, times the hook type's learned multiplier."""
    o = v.outcomes(s, d)
    of = lambda i, c: F.when((F.col("post_id") + i) % 7 == 0, None).otherwise(F.round(F.col(M[i % 4]) * (3 + i), 3)).alias(c)
    t = perf.rubric_totals(perf.rubric_rows(o.select("post_id", *(of(i, c) for i, c in enumerate(perf.RUBRIC))), "post_id"), "post_id")
    kinds = t.join(o.select("post_id", "hook_type"), "post_id")
    return store.left_with_defaults(kinds, hook_priors(s, d), "hook_type", {"multiplier": 1.0}).select("post_id", *(perf.half_up(F.col(c), 4).alias(c) for c in ("base", "deterministic", "llm")), "unjudged", perf.half_up(F.col("base") * F.col("multiplier"), 2).alias("total"))


def median_spread(s, d):
    """Median and median distance to it, by platform: exact, from a range sort."""
    return ranks.median_deviations(v.outcomes(s, d), ["platform"], "completion_rate").select("platform", R("median"), R("mad"))


def union_all(s, d):
    p = v.posts(s, d)
    return p.where("platform = '1-URGENT'").select("post_id", F.lit("current").alias("part")).unionByName(p.where("total > 200000").select("post_id", F.lit("past").alias("part")))


def set_intersect(s, d):
    p = v.posts(s, d)
    return p.where("variant = 'A'").select("clip_id", "platform").intersect(p.where("variant = 'B'").select("clip_id", "platform"))


def set_except(s, d):
    p = v.posts(s, d)
    return p.select("clip_id").subtract(p.where("variant = 'B'").select("clip_id"))


def multiset_intersect(s, d):
    p = v.posts(s, d)
    return p.where("variant = 'A'").select("platform", "hook_type", "clip_id").intersectAll(p.where("variant = 'B'").select("platform", "hook_type", "clip_id"))


def map_merge(s, d):
    m = v.metrics(s, d)
    a = F.create_map(F.lit("ctr"), F.when(F.col("flag") != "N", F.col("ctr")), F.lit("flag_r"), F.when(F.col("flag") == "R", 1.0))
    b = F.create_map(F.lit("ctr"), F.lit(-1.0), F.lit("extra"), F.lit(2.0))
    got = perf.first_wins(a, b)
    return m.select("post_id", "window", got["ctr"].alias("ctr"), got["flag_r"].alias("flag_r"), got["extra"].alias("extra"))


QUERIES = {f.__name__: f for f in (
    outcomes_join, zscore_platform, hqs_composite, hook_ranking, hook_gap_drivers, ab_lift_by_platform, ab_verdict, provenance_rollup, simulated_share, real_weight, hook_priors, hook_priors_sampled, newest_snapshot, upsert_converges,
    left_join_default, anti_accounting, fallback_key_join, posts_x_windows, target_window_fallback, store_counts, minmax_gate_pick, criteria_long, derived_keys, status_filter, membership_semi, classify_case, issue_rows, inner_skip,
    dim_lookup_default, group_stats, percentiles, distinct_sets, rubric_total, rubric_twelve, median_spread, union_all, set_intersect, set_except, multiset_intersect, map_merge,
)}

_P, _M, _O, _S = f"WITH {v.POSTS}", f"WITH {v.METRICS}", v.WITH_OUTCOMES, v.WITH_SCORED
_REAL = {m: "flag IN ('R', 'A')" if i % 2 == 0 else "flag = 'R'" for i, m in enumerate(M)}
_FRACTION = "(" + " + ".join(f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END" for c in _REAL.values()) + ") / 4"
_WEIGHT = "(" + " + ".join(f"CASE WHEN {c} THEN {perf.WEIGHTS[m]}::DOUBLE ELSE 0 END" for m, c in _REAL.items()) + ")"
_RANK = """ranking AS (SELECT *, row_number() OVER (ORDER BY hqs_shrunk DESC, hook_type) AS rank FROM (
  SELECT hook_type, count(*) AS n, round(avg(hqs), 4) AS hqs_mean, round(count(*) * avg(hqs) / (count(*) + 5), 4) AS hqs_shrunk FROM scored GROUP BY hook_type))"""
_UP = "floor(({0}) * 1e{1} + 0.5::DOUBLE) / 1e{1}"
_MEAN = "(sum(({0})::DECIMAL(28,9))::DOUBLE / count({0}))"
_LIFTS = "lifts AS (SELECT *, " + _UP.format(" + ".join(f"{w}::DOUBLE * lift_{m}" for m, w in perf.WEIGHTS.items()), 4) + " AS composite_lift FROM (SELECT ab_group, platform, n_a, n_b, " + ", ".join(f"CASE WHEN a_{m} > 0 THEN (b_{m} - a_{m}) / a_{m} + 0.0 ELSE 0 END AS lift_{m}" for m in M) + " FROM (SELECT ab_group, platform, count_if(variant = 'A')::BIGINT AS n_a, count_if(variant = 'B')::BIGINT AS n_b, " + ", ".join(_MEAN.format(f"CASE WHEN variant = '{x.upper()}' THEN {m} END") + f" AS {x}_{m}" for m in M for x in "ab") + " FROM outcomes GROUP BY ab_group, platform) WHERE n_a > 0 AND n_b > 0))"
_PRIORS = f"""aged AS (SELECT *, (epoch_us(max(collected_at) OVER ()) - epoch_us(collected_at)) / 86400e6 AS age FROM scored),
taught AS (SELECT hook_type, sum(exp(-age / 90)) AS n, sum(exp(-age / 90) * hqs) AS s FROM aged WHERE {_WEIGHT} >= 0.6 GROUP BY hook_type),
types AS (SELECT DISTINCT hook_type FROM scored),
j AS (SELECT hook_type, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN s / n ELSE 0 END AS y_bar FROM types LEFT JOIN taught USING (hook_type)),
k AS (SELECT *, n / (n + 8) * y_bar AS y_hat, 0.6::DOUBLE / sqrt(n + 1) AS sigma FROM j),
priors AS (SELECT hook_type, round(n, 3) AS n_eff, round(y_bar, 4) AS y_bar, round(y_hat, 4) AS y_hat, round(sigma, 4) AS sigma, round(greatest(0.8, least(1.25, exp(0.35::DOUBLE * y_hat))), 4) AS multiplier FROM k)"""
_U = "('0x' || substr(sha256('run|' || hook_type), {0}, 8))::BIGINT::DOUBLE / 4294967296"
SQL = {
    "outcomes_join": f"{_O} SELECT post_id, clip_id, platform, hook_type, \"window\", {', '.join(M)} FROM outcomes",
    "zscore_platform": f"{_S} SELECT post_id, {', '.join(f'round(z_{m}, 6) AS z_{m}' for m in M)} FROM scored",
    "hqs_composite": f"{_S} SELECT post_id, round(hqs, 5) AS hqs FROM scored",
    "hook_ranking": f"{_S}, {_RANK} SELECT hook_type, n, hqs_mean, hqs_shrunk, rank::INTEGER AS rank FROM ranking",
    "hook_gap_drivers": f"""{_S}, {_RANK}, means AS (SELECT hook_type, {', '.join(f'avg(z_{m}) AS {m}' for m in M)} FROM scored GROUP BY hook_type),
ends AS (SELECT arg_min(hook_type, rank) AS winner, arg_max(hook_type, rank) AS loser FROM ranking),
sides AS (SELECT w.metric, w.z AS w, l.z AS l FROM (UNPIVOT means ON {', '.join(M)} INTO NAME metric VALUE z) w JOIN (UNPIVOT means ON {', '.join(M)} INTO NAME metric VALUE z) l USING (metric), ends WHERE w.hook_type = winner AND l.hook_type = loser),
c AS (SELECT *, CASE metric {' '.join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in perf.WEIGHTS.items())} END * (w - l) AS c FROM sides)
SELECT metric, round(w, 3) AS winner_z, round(l, 3) AS loser_z, round(c, 4) AS contribution, CASE WHEN c > 0 THEN round(c / sum(c) FILTER (c > 0) OVER (), 4) ELSE 0.0::DOUBLE END AS share FROM c""",
    "ab_lift_by_platform": f"{_O}, {_LIFTS} SELECT ab_group, platform, n_a, n_b, {', '.join(f'{_UP.format(f"lift_{m}", 5)} AS lift_{m}' for m in M)}, {_UP.format("composite_lift", 3)} AS composite_lift FROM lifts",
    "ab_verdict": f"""{_O}, {_LIFTS}, g AS (SELECT ab_group, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, count(*) AS platforms, {_MEAN.format("composite_lift")} AS m, count_if(composite_lift > 0) AS up, count_if(composite_lift < 0) AS down FROM lifts GROUP BY ab_group),
h AS (SELECT *, (CASE WHEN m > 0 THEN up WHEN m < 0 THEN down ELSE 0 END)::BIGINT AS platforms_agreeing, abs(m) >= 0.05 AS material FROM g)
SELECT ab_group, n_a, n_b, platforms, {_UP.format("m", 3)} AS mean_lift, platforms_agreeing, material, CASE WHEN material AND platforms_agreeing = platforms THEN CASE WHEN m > 0 THEN 'B' ELSE 'A' END END AS winner FROM h""",
    "provenance_rollup": f"{_O} SELECT post_id, CASE flag WHEN 'R' THEN 'REAL' WHEN 'A' THEN 'MIXED' ELSE 'SIMULATED' END AS provenance FROM outcomes",
    "simulated_share": f"{_O} SELECT hook_type, round(1 - avg({_FRACTION}), 6) AS simulated_share, count_if({_WEIGHT} >= 0.6)::BIGINT AS teaching FROM outcomes GROUP BY hook_type",
    "real_weight": f"{_O} SELECT post_id, round({_WEIGHT}, 6) AS real_weight FROM outcomes",
    "hook_priors": f"{_S}, {_PRIORS} SELECT * FROM priors",
    "hook_priors_sampled": f"""{_S}, {_PRIORS} SELECT hook_type, round(round(CASE WHEN n > 0 THEN greatest(0.8, least(1.25, exp(0.35::DOUBLE * (y_hat + sigma * sqrt(-2 * ln(greatest(1e-12, {_U.format(1)}))) * cos(2 * pi() * {_U.format(9)}))))) ELSE 1.0 END, 4), 3) AS sampled_multiplier FROM k""",
    "newest_snapshot": f'{_M} SELECT post_id, "window", collected_at, ctr FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY collected_at DESC, "window" DESC) AS rn FROM metrics) WHERE rn = 1',
    "upsert_converges": f"""{_M} SELECT coalesce(a.post_id, b.post_id) AS post_id, coalesce(a."window", b."window") AS "window", a.hook_retention_3s, round(coalesce(b.ctr + 1, a.ctr), 6) AS ctr
FROM (SELECT * FROM metrics WHERE "window" IN ('w1', 'w2')) a FULL JOIN (SELECT * FROM metrics WHERE "window" IN ('w2', 'w3')) b ON a.post_id = b.post_id AND a."window" = b."window\"""",
    "left_join_default": f"""WITH {v.POSTS}, {v.METRICS} SELECT p.post_id, p.platform, coalesce(ctr, 0) AS ctr, coalesce(flag, 'none') AS flag FROM posts p LEFT JOIN (SELECT * FROM metrics WHERE "window" = 'w2') m USING (post_id)""",
    "anti_accounting": f"""WITH {v.POSTS}, {v.METRICS} SELECT post_id, CASE WHEN post_id IN (SELECT post_id FROM metrics WHERE "window" = 'w7') THEN 'ok' ELSE 'skipped_no_metrics' END AS outcome FROM posts""",
    "fallback_key_join": f"""{_P}, c AS (SELECT clip_id, min(platform) AS platform FROM posts WHERE clip_id % 7 = 0 GROUP BY clip_id)
SELECT post_id, p.platform, CASE WHEN post_id % 10 = 0 THEN 'post' WHEN c.platform = p.platform THEN 'clip' END AS remote_id FROM posts p LEFT JOIN c USING (clip_id)""",
    "posts_x_windows": f"""{_P} SELECT post_id, w AS "window", n::INTEGER AS days FROM posts, (VALUES ('T+1h', 0), ('T+24h', 1), ('T+7d', 7), ('T+30d', 30)) x(w, n)""",
    "target_window_fallback": f"""{_M} SELECT post_id, "window", ctr FROM metrics QUALIFY "window" = coalesce(max(CASE WHEN "window" = 'w2' THEN "window" END) OVER (PARTITION BY post_id), max("window") OVER (PARTITION BY post_id))""",
    "store_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
    "minmax_gate_pick": f"""{_M}, s AS (SELECT *, round((0.6::DOUBLE * CASE WHEN max(completion_rate) OVER w - min(completion_rate) OVER w <= 1e-9 THEN 0.5 ELSE (completion_rate - min(completion_rate) OVER w) / (max(completion_rate) OVER w - min(completion_rate) OVER w) END
  + 0.4::DOUBLE * CASE WHEN max(hook_retention_3s) OVER w - min(hook_retention_3s) OVER w <= 1e-9 THEN 0.5 ELSE (hook_retention_3s - min(hook_retention_3s) OVER w) / (max(hook_retention_3s) OVER w - min(hook_retention_3s) OVER w) END) * CASE WHEN flag = 'N' THEN 0.25::DOUBLE ELSE 1 END, 6) AS score
  FROM metrics WINDOW w AS (PARTITION BY post_id)) SELECT post_id, "window", score FROM s QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY score DESC, "window") = 1""",
    "criteria_long": f'{_M} SELECT post_id, "window", criterion, raw FROM (SELECT post_id, "window", {", ".join(M)} FROM metrics) UNPIVOT INCLUDE NULLS (raw FOR criterion IN ({", ".join(M)}))',
    "derived_keys": f"""{_M} SELECT post_id, "window", post_id || '|' || "window" AS metric_id FROM metrics""",
    "status_filter": f"{_P} SELECT post_id, status, round(total, 2) AS total FROM posts WHERE status = 'F' AND total >= 150000",
    "membership_semi": f"{_P} SELECT post_id, clip_id FROM posts WHERE clip_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "classify_case": f"""{_M} SELECT post_id, "window", CASE WHEN ctr >= 0.08 THEN 'high' WHEN ctr >= 0.04 AND flag = 'N' THEN 'fresh' WHEN ctr >= 0.04 THEN 'mid' ELSE 'low' END AS label FROM metrics""",
    "issue_rows": f"""{_P} SELECT post_id, 'too_large' AS code, 'error' AS severity FROM posts WHERE total > 300000 UNION ALL SELECT post_id, 'pending', 'warning' FROM posts WHERE status = 'P' UNION ALL SELECT post_id, 'unspecified', 'info' FROM posts WHERE platform LIKE '4%'""",
    "inner_skip": f"""WITH {v.POSTS}, {v.METRICS} SELECT post_id, hook_type, ctr FROM posts JOIN metrics USING (post_id) WHERE "window" = 'w7'""",
    "dim_lookup_default": f"{_P} SELECT post_id, platform, (CASE platform WHEN '1-URGENT' THEN 0.18 WHEN '2-HIGH' THEN 0.55 WHEN '3-MEDIUM' THEN 0.85 ELSE 0.6 END)::DOUBLE AS maturity FROM posts",
    "group_stats": f"{_O} SELECT hook_type, count(*) AS n, round(avg(ctr), 6) AS mean, max(ctr) AS top, min(ctr) AS low FROM outcomes GROUP BY hook_type",
    "percentiles": f"{_O} SELECT platform, p95, mid, round(p95 - mid, 5) AS spread FROM (SELECT platform, round(quantile_cont(completion_rate, 0.95), 6) AS p95, round(median(completion_rate), 6) AS mid FROM outcomes GROUP BY platform)",
    "distinct_sets": f"{_P} SELECT hook_type, count(DISTINCT platform) AS platforms, count(DISTINCT clip_id) AS clips FROM posts GROUP BY hook_type",
    "rubric_total": f"""{_S}, {_PRIORS}, b AS (SELECT post_id, hook_type, {' + '.join(f'round(least(10.0::DOUBLE, greatest(0.0::DOUBLE, {m} * 10)) / 10 * {w * 100}::DOUBLE, 4)' for m, w in perf.WEIGHTS.items())} AS base FROM outcomes)
SELECT post_id, round(base, 3) AS base, round(base * coalesce(multiplier, 1), 2) AS total FROM b LEFT JOIN priors USING (hook_type)""",
    "rubric_twelve": f"""{_S}, {_PRIORS}, r AS (SELECT post_id, hook_type, {', '.join(f"CASE WHEN (post_id + {i}) % 7 <> 0 THEN round({M[i % 4]} * {3 + i}, 3) END AS {c}" for i, c in enumerate(perf.RUBRIC))} FROM outcomes),
p AS (SELECT post_id, hook_type, {', '.join(f"least(10::DOUBLE, greatest(0::DOUBLE, coalesce({c}, 5.0::DOUBLE))) / 10 * {w} AS p_{c}" for c, (w, _) in perf.RUBRIC.items())}, {' + '.join(f"({c} IS NULL)::BIGINT" for c in perf.RUBRIC)} AS unjudged FROM r),
t AS (SELECT post_id, hook_type, unjudged, {' + '.join(f"p_{c}" for c, (_, k) in perf.RUBRIC.items() if k == "deterministic")} AS deterministic, {' + '.join(f"p_{c}" for c, (_, k) in perf.RUBRIC.items() if k == "llm")} AS llm FROM p),
b AS (SELECT *, round(deterministic, 9) + round(llm, 9) AS base FROM t)
SELECT post_id, floor(round(base, 9) * 1e4 + 0.5::DOUBLE) / 1e4 AS base, floor(round(deterministic, 9) * 1e4 + 0.5::DOUBLE) / 1e4 AS deterministic, floor(round(llm, 9) * 1e4 + 0.5::DOUBLE) / 1e4 AS llm, unjudged, floor(round(base, 9) * coalesce(multiplier, 1) * 1e2 + 0.5::DOUBLE) / 1e2 AS total FROM b LEFT JOIN priors USING (hook_type)""",
    "median_spread": f"{_O}, m AS (SELECT platform, median(completion_rate) AS m FROM outcomes GROUP BY platform) SELECT platform, round(m, 6) AS median, round(median(abs(completion_rate - m)), 6) AS mad FROM outcomes JOIN m USING (platform) GROUP BY platform, m",
    "union_all": f"{_P} SELECT post_id, 'current' AS part FROM posts WHERE platform = '1-URGENT' UNION ALL SELECT post_id, 'past' FROM posts WHERE total > 200000",
    "set_intersect": f"{_P} SELECT clip_id, platform FROM posts WHERE variant = 'A' INTERSECT SELECT clip_id, platform FROM posts WHERE variant = 'B'",
    "set_except": f"{_P} SELECT clip_id FROM posts EXCEPT SELECT clip_id FROM posts WHERE variant = 'B'",
    "multiset_intersect": f"{_P} SELECT platform, hook_type, clip_id FROM posts WHERE variant = 'A' INTERSECT ALL SELECT platform, hook_type, clip_id FROM posts WHERE variant = 'B'",
    "map_merge": f"""{_M} SELECT post_id, "window", CASE WHEN flag <> 'N' THEN ctr ELSE -1 END AS ctr, CASE WHEN flag = 'R' THEN 1.0::DOUBLE END AS flag_r, 2.0::DOUBLE AS extra FROM metrics""",
}

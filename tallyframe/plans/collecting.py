"""Queries on API responses, collected logs and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_binary
from ..operators import collect
from . import views as v


def responses(s, d) -> DataFrame:
    """Answers to three calls for every order and line number, as an API words them: columns in two orders, some of
    them absent, answers without rows, cut-off bodies and values that are no numbers."""
    columns = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    li = v.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in columns))
    text = lambda x: F.to_json(F.struct(x.alias("v")))
    number = lambda x: F.regexp_extract(text(x), r'^\{"v":(.*)\}$', 1)
    odd, key = F.col("l_linenumber") % 2 == 1, F.col("l_orderkey")
    likes = F.when(key % 17 == 0, F.lit('"n/a"')).otherwise(number(F.col("l_suppkey") % 50))
    percent, views = number(F.col("l_extendedprice") / 1000), number(F.col("l_partkey") % 1000)

    def answer(pairs):
        heads = ", ".join(f'{{"name": "{n}", "dataType": "FLOAT"}}' for n, _ in pairs)
        return F.concat(F.lit(f'{{"columnHeaders": [{heads}], "rows": ['), F.when(key % 13 == 0, "").otherwise(F.concat(F.lit("["), F.concat_ws(", ", *(x for _, x in pairs)), F.lit("]"))), F.lit("]}"))

    one = answer([("views", views), ("likes", likes), ("averageViewPercentage", percent), ("shares", number(F.col("l_linenumber")))])
    two = answer([("averageViewDuration", number(F.col("l_quantity"))), ("averageViewPercentage", percent), ("comments", number(F.col("l_suppkey") % 7)), ("views", views), ("annotationClickThroughRate", number(F.col("l_tax") / 3))])
    # cut by a length, so that the body is worded once in the code: twice, its method is too long to be compiled
    core = F.substring(F.when(odd, one).otherwise(two), F.lit(1), F.when(key % 11 == 0, 60).otherwise(1 << 20))
    kept = F.concat(F.lit('{"rows": [[0, 1.0], [0.25, '), number(1 - F.col("l_discount")), F.lit("], [0.5, "), number(0.6 - F.col("l_tax")), F.lit("], [1, 0.2]]}"))
    counters = F.when(key % 5 == 0, '{"items": []}').otherwise(F.concat(F.lit('{"items": [{"statistics": {"likeCount": "'), (F.col("l_suppkey") % 90).cast("string"), F.lit('", "commentCount": "'), (F.col("l_suppkey") % 9).cast("string"), F.lit('"}}]}')))
    calls = F.explode(F.array(*(F.struct(F.lit(n).alias("call"), b.alias("body")) for n, b in (("core", core), ("retention", kept), ("lifetime", counters)))))
    length = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity") * 2)
    return li.select(key.alias("post_id"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("window"), length.cast("double").alias("duration_s"), calls.alias("c")).select("post_id", "window", "duration_s", "c.call", "c.body")


def metric_responses(s, d):
    """Every answer's fields, merged by precedence, with what went wrong and how much was measured."""
    p = collect.collected_share(collect.parse_responses(responses(s, d)))
    curve = F.col("retention_curve")
    return p.select("post_id", "window", *(f for f in collect.FIELDS if f != "retention_curve"), F.size(curve).alias("points"), F.get(curve, F.lit(1))["x"].alias("second_x"), F.get(curve, F.lit(1))["y"].alias("second_y"), F.array_join("errors", "; ").alias("errors"), "n_measured", "provenance")


def half_even(s, d):
    """Binary halves: values that are halves only in decimal, and some that are halves in binary."""
    li, x = v.table(s, d, "lineitem"), F.col("l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", round_binary(x / 1000, 2).alias("cents"), round_binary(F.col("l_quantity") / 8 + 0.5, 2).alias("eighths"), round_binary(-x / 2000, 1).alias("tenths"), round_binary(x * 0.0001 + F.col("l_tax"), 4).alias("four"))


QUERIES = {f.__name__: f for f in (metric_responses, half_even)}

#: printf rounds by the exact binary value.
_round = lambda x, n: f"format('{{:.{n}f}}', ({x})::DOUBLE)::DOUBLE"
SQL = {
    "half_even": f"SELECT l_orderkey, l_linenumber, {_round('l_extendedprice::DOUBLE / 1000', 2)} AS cents, {_round('l_quantity::DOUBLE / 8 + 0.5::DOUBLE', 2)} AS eighths, {_round('-l_extendedprice::DOUBLE / 2000', 1)} AS tenths, {_round('l_extendedprice::DOUBLE * 0.0001::DOUBLE + l_tax::DOUBLE', 4)} AS four FROM lineitem",
    "metric_responses": f"""
WITH lines AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2
), r AS (
  SELECT l_orderkey AS post_id, 'w' || l_linenumber AS "window", l_linenumber % 2 = 1 AS odd, l_orderkey % 11 = 0 AS broken, l_orderkey % 13 = 0 AS bare, l_orderkey % 5 = 0 AS none, (l_orderkey % 17 = 0 AND l_linenumber % 2 = 1 AND l_orderkey % 13 <> 0 AND l_orderkey % 11 <> 0) AS odd_value,
    (l_partkey % 1000)::BIGINT AS v, (l_suppkey % 50)::BIGINT AS lk, (l_suppkey % 7)::BIGINT AS cm, l_linenumber::BIGINT AS sh, l_quantity::DOUBLE AS dur, l_extendedprice::DOUBLE / 1000 AS pct, l_tax::DOUBLE / 3 AS ct, (l_suppkey % 90)::BIGINT AS all_lk, (l_suppkey % 9)::BIGINT AS all_cm,
    CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity::DOUBLE * 2 END AS len, 1 - l_discount::DOUBLE AS y1, 0.6::DOUBLE - l_tax::DOUBLE AS y2 FROM lines
), c AS (
  SELECT *, NOT broken AND NOT bare AND NOT odd_value AS ok, 3 / nullif(len, 0) AS t FROM r
), f AS (
  SELECT *, CASE WHEN ok THEN v END AS views, CASE WHEN ok AND odd THEN lk END AS c_likes, CASE WHEN ok AND NOT odd THEN cm END AS c_comments, CASE WHEN ok AND odd THEN sh END AS shares,
    CASE WHEN len > 0 THEN CASE WHEN t <= 0 THEN 1 WHEN t <= 0.25 THEN 1 + t / 0.25::DOUBLE * (y1 - 1) WHEN t <= 0.5 THEN y1 + (t - 0.25::DOUBLE) / 0.25::DOUBLE * (y2 - y1) WHEN t <= 1 THEN y2 + (t - 0.5::DOUBLE) / 0.5::DOUBLE * (0.2::DOUBLE - y2) ELSE 0.2::DOUBLE END END AS share FROM c
), g AS (
  SELECT *, CASE WHEN none THEN NULL ELSE all_lk END AS l_likes, CASE WHEN none THEN NULL ELSE all_cm END AS l_comments, {_round("coalesce(c_likes, 0) + coalesce(c_comments, 0) + coalesce(shares, 0)", 0)} AS acts FROM f
), h AS (
  SELECT post_id, "window", views, coalesce(c_likes, l_likes) AS likes, coalesce(c_comments, l_comments) AS comments, shares, CASE WHEN ok AND NOT odd THEN dur END AS avg_view_duration_s, CASE WHEN ok THEN {_round("pct / 100", 4)} END AS completion_rate,
    CASE WHEN ok AND NOT odd THEN {_round("ct", 5)} END AS ctr, CASE WHEN views <> 0 THEN {_round("acts / views", 5)} END AS engagement_rate, {_round("share", 4)} AS hook_retention_3s, CASE WHEN share IS NOT NULL THEN {_round("greatest(0, 1 - share)", 4)} END AS dropoff_3s,
    CASE WHEN len > 0 THEN 4 END AS points, CASE WHEN len > 0 THEN {_round("0.25::DOUBLE * len", 2)} END AS second_x, CASE WHEN len > 0 THEN {_round("y1", 4)} END AS second_y, CASE WHEN broken THEN 'core: not JSON' WHEN odd_value THEN 'core: not a number' ELSE '' END AS errors FROM g
)
SELECT * EXCLUDE (n), n::INTEGER AS n_measured, CASE n WHEN 10 THEN 'REAL' WHEN 0 THEN 'SIMULATED' ELSE 'MIXED' END AS provenance FROM (
  SELECT *, (views IS NOT NULL)::INT + (likes IS NOT NULL)::INT + (comments IS NOT NULL)::INT + (shares IS NOT NULL)::INT + (avg_view_duration_s IS NOT NULL)::INT + (completion_rate IS NOT NULL)::INT + (ctr IS NOT NULL)::INT + (engagement_rate IS NOT NULL)::INT + (hook_retention_3s IS NOT NULL)::INT + (dropoff_3s IS NOT NULL)::INT AS n FROM h)
""",
}

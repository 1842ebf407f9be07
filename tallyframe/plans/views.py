"""The driver's tables seen as posts, metrics, texts, words, intervals and samples; and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def posts(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    variant = F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("clip_id"), F.col("o_orderpriority").alias("platform"), F.col("c_mktsegment").alias("hook_type"),
        variant.alias("variant"), F.col("o_custkey").alias("ab_group"), F.col("o_orderdate").alias("published_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"),
    )


def metrics(spark: SparkSession, d: str, *windows: int) -> DataFrame:
    """Metrics by post and window; with windows given, the filter reaches the scan."""
    li = table(spark, d, "lineitem")
    li = li.where(F.col("l_linenumber").isin(*windows)) if windows else li
    mean = lambda c: F.round(F.avg(c), 6)
    return li.groupBy(F.col("l_orderkey").alias("post_id"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("window")).agg(
        mean(1 - F.col("l_discount")).alias("hook_retention_3s"), F.round(F.avg("l_quantity") / 50, 6).alias("completion_rate"), mean("l_tax").alias("engagement_rate"), mean("l_discount").alias("ctr"),
        F.max("l_shipdate").alias("collected_at"), F.max("l_returnflag").alias("flag"),
    )


def outcomes(spark: SparkSession, d: str, window: int = 1) -> DataFrame:
    """Posts with their metrics of one window."""
    return metrics(spark, d, window).join(posts(spark, d), "post_id")


POSTS = """posts AS (SELECT o_orderkey AS post_id, o_custkey AS clip_id, o_orderpriority AS platform, c_mktsegment AS hook_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS variant, o_custkey AS ab_group, o_orderdate AS published_at, o_orderstatus AS status, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
METRICS = """metrics AS (SELECT l_orderkey AS post_id, 'w' || l_linenumber AS "window", round(avg(1 - l_discount), 6) AS hook_retention_3s, round(avg(l_quantity) / 50, 6) AS completion_rate,
  round(avg(l_tax), 6) AS engagement_rate, round(avg(l_discount), 6) AS ctr, max(l_shipdate) AS collected_at, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"""
OUTCOMES = """outcomes AS (SELECT m.*, p.* EXCLUDE (post_id) FROM metrics m JOIN posts p USING (post_id) WHERE "window" = 'w1')"""
_z = """CASE WHEN coalesce(stddev_samp({m}) OVER w, 0) <= 1e-12 * abs(avg({m}) OVER w) THEN 0.0::DOUBLE ELSE ({m} - avg({m}) OVER w) / stddev_samp({m}) OVER w END AS z_{m}"""
SCORED = "scored AS (SELECT *, 0.45::DOUBLE * z_hook_retention_3s + 0.25::DOUBLE * z_completion_rate + 0.20::DOUBLE * z_engagement_rate + 0.10::DOUBLE * z_ctr AS hqs FROM (SELECT *, " + ", ".join(_z.format(m=m) for m in ("hook_retention_3s", "completion_rate", "engagement_rate", "ctr")) + " FROM outcomes WINDOW w AS (PARTITION BY platform)))"
WITH_OUTCOMES = f"WITH {POSTS}, {METRICS}, {OUTCOMES}"
WITH_SCORED = f"{WITH_OUTCOMES}, {SCORED}"

#: Words of documents on a made-up clock, with a pause after each 17th.
TOKEN = r"[\p{L}\p{N}_]+"


def clock(pos: Column) -> tuple[Column, Column]:
    """When the word at a place starts and ends. Both are whole twentieths, so the nearest thousandth is no tie and
    needs no decimal arithmetic."""
    near = lambda x: F.rint(x * 1000) / 1000
    start = near(0.3 * pos + F.floor(pos / 17))
    return start, near(start + 0.25)


def words_of(docs: DataFrame) -> DataFrame:
    doc = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("pos", "w"))
    start, end = clock(F.col("pos"))
    return doc.select("doc_id", F.col("pos").cast("long").alias("pos"), "w", start.alias("start"), end.alias("end"))


def words(spark: SparkSession, d: str) -> DataFrame:
    return words_of(table(spark, d, "documents"))


def by_row(docs: DataFrame, own: Callable[[DataFrame], DataFrame], shared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """own(documents that are all rows of their id) and shared(the others): what belongs to one document is
    worked out in its row and its words aren't shuffled, while rows of one id, or without, count as one document."""
    again = docs.groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again")
    if again.isEmpty():
        return own(docs)
    same = docs["doc_id"].eqNullSafe(again["again"])
    return own(docs.join(again, same, "left_anti")).unionByName(shared(docs.join(again, same, "left_semi")))


WORDS = r"""words AS (SELECT doc_id, pos, w, round(0.3::DOUBLE * pos + floor(pos / 17), 3) AS start, round(round(0.3::DOUBLE * pos + floor(pos / 17), 3) + 0.25::DOUBLE, 3) AS "end"
  FROM (SELECT doc_id, unnest(t) AS w, (unnest(range(len(t))))::BIGINT AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS t FROM documents)))"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents with words, in order."""
    return sentences_of(table(spark, d, "documents"))


def sentences_of(docs: DataFrame) -> DataFrame:
    t = docs.select("doc_id", F.posexplode(F.split("text", r"\n")).alias("line", "text"))
    return t.select("doc_id", F.col("line").cast("long").alias("line"), "text", F.regexp_extract_all("text", F.lit(TOKEN), 0).alias("tokens"))


SENTENCES = r"""sentences AS (SELECT doc_id, line, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS tokens FROM (
  SELECT doc_id, unnest(t) AS text, (unnest(range(len(t))))::BIGINT AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"""


def intervals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", F.col("event_type").alias("video"), start.alias("start"), (start + 10 * F.col("value")).alias("end"), F.col("value").alias("score"))


INTERVALS = """intervals AS (SELECT event_id, event_type AS video, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + 10 * value AS "end", value AS score FROM events)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id")
    x = F.when(F.col("event_type") != "error", F.col("value"))
    return e.select("user_id", "event_id", F.round((F.col("us") - F.min("us").over(w)) / 1e6, 3).alias("t"), x.alias("x"), (F.col("event_type") == "signup").cast("int").alias("cut"))


SAMPLES = """samples AS (SELECT user_id, event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 3) AS t, CASE WHEN event_type <> 'error' THEN value END AS x,
  (event_type = 'signup')::INTEGER AS cut FROM events)"""

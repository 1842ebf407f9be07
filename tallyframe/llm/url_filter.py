"""URL filtering: rules first, then trust and distrust propagated over the graph of hosts.

Trust is personalised PageRank from the hosts of allowed pages along the edges; distrust is the
same from the hosts of blocked pages along the reversed edges. A host is blocked when distrust
exceeds its share of both by the threshold. Host edges come from links in the pages that name a host and,
weakly, from each host to its parent domain and back, so that hosts without links are judged by
their domain. DataFrame functions only.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule, and is
allowed. A null html has no links. A null page_id is kept, repeated rows are judged alike, an
empty table gives no rows, and other columns are ignored. A host that no seed reaches is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (host and path, verdict) pairs of the query.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
DAMPING, PARENT_WEIGHT, THRESHOLD = 0.85, 0.25, 0.5
#: Propagation ends when a kind's ranks change by less in sum; rounds between two looks, and rounds after which it raises.
TOLERANCE, LOOK, MOST_ROUNDS = 1e-6, 6, 300


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. The rules are a short list, tried in turn."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, from pages with host and html columns: absolute
    links, and those that take over the page's scheme. Other links lead to the page's own host, which
    no walk between hosts needs."""
    named = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?((?:[a-z]+:)?//[^\"'\s>]*)"), 1)
    targets = F.transform(named, lambda u: ascii_lower(F.regexp_extract(u, "^(?:[A-Za-z]+:)?//([^/?#]*)", 1)))
    links = pages.where("html like '%//%' and host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    linked = links.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").where("host <> ''").union(linked.select("dst")).distinct()
    parent = hosts.select(F.col("host").alias("a"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("b")).where("b <> ''").distinct()
    weak = parent.union(parent.select("b", "a")).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(PARENT_WEIGHT).alias("weight"))
    return linked.union(weak).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank for several kinds at once: edges (kind, src, dst, weight), seeds
    (kind, host, seed) that sum to 1 for a kind -> (kind, host, rank). Mass without a way on
    leaves the walk. A round is a join and a sum that combines before its shuffle. Without a
    number of rounds it goes on until a round changes no kind's ranks by TOLERANCE in sum.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    share = stored(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share")))
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank = seeds.select("kind", "host", F.col("seed").alias("rank"))
    for i in range(MOST_ROUNDS if rounds is None else rounds):
        look = rounds is None and i % LOOK == LOOK - 1
        before = rank = stored(rank) if look else rank
        moved = rank.join(share, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = moved.union(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if look or i % 3 == 2 or i + 1 == rounds:
            rank = stored(rank)
        if look:
            change = rank.union(before.select("kind", "host", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("d")).groupBy("kind").agg(F.sum("d").alias("d"))
            if (change.agg(F.max("d")).first()[0] or 0.0) < TOLERANCE:
                return rank
    if rounds is None:
        raise RuntimeError(f"ranks still change after {MOST_ROUNDS} rounds")
    return rank


def filter_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: a row per page."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", "html").select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    edges = stored(host_edges(judged.select("host", "html")))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    kind = F.when(F.col("found.verdict") == "allow", "trust").otherwise("distrust")
    seeded = judged.where("found is not null").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    totals = seeded.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = stored(seeded.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed")))
    rank = propagate(both, seeds, damping, rounds)
    scores = rank.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    scored = judged.select("page_id", "host", "path", "found").join(scores.withColumnRenamed("host", "s_host"), F.col("host") == F.col("s_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", verdict).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))

"""WARC revisits: a not-modified record takes its body and most headers from the latest earlier full
response for the same canonical URL, found by an as-of join, if the validators agree.

The as-of join carries "the last full response so far" along each URL's records. Time is divided
into slices at global quantiles, so a hot URL's records are spread over many (URL, slice) groups;
each slice's last response is a small row, and those are carried from slice to slice.

Defined cases: a null url has a null canonical form and resolves with nothing; a null or earlier-
than-all time finds no response; of responses at the same time the largest record_id is the later;
a response at the revisit's own time counts as earlier; a missing validator on either side agrees
with anything only if the other kind agrees; repeated rows are records of their own; null header
maps are empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: Headers that describe the stored body; a 304 must not replace them.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no www, default port, fragment, tracking parameters or trailing
    slash; the other parameters in order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    start = ascii_lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    start = F.regexp_replace(F.regexp_replace(start, "^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2"), "^https?://(www[.])?", "http://")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    query = F.array_join(F.array_sort(params), "&")
    return F.when(url.isNull(), None).otherwise(F.concat(start, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def as_of(records: DataFrame, key: str, at: str, tie: str, is_right: Column, right: Column, slices: int = SLICES) -> DataFrame:
    """The records with a column `found`: `right` of the latest record with is_right at or before each."""
    edges = records.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000).alias("edges")).first().edges or []
    edges = sorted(set(edges))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(at))) if edges else F.lit(0)
    rows = records.withColumn("_part", F.coalesce(part, F.lit(0))).withColumn("_right", F.when(is_right & F.col(key).isNotNull() & F.col(at).isNotNull(), right)).withColumn("_salt", F.when(F.col(key).isNull(), F.xxhash64(tie)))
    order = [F.col(at).asc_nulls_first(), F.when(is_right, 0).otherwise(1), F.col(tie)]
    inside = Window.partitionBy(key, "_salt", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", F.last("_right", ignorenulls=True).over(inside))
    lasts = rows.where("_right is not null").groupBy(F.col(key).alias("_key"), "_part").agg(F.max_by("_right", F.struct(at, tie)).alias("_last"))
    # the slice's own rows look further back only where their slice has no response yet
    gaps = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = gaps.join(lasts, ["_key", "_part"], "left").select("_key", F.col("_part").alias("_c_part"), F.last("_last", ignorenulls=True).over(before).alias("_far")).where("_far is not null")
    out = near.join(carried, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_c_part")), "left")
    found = F.when(F.col(at).isNotNull(), F.coalesce("_near", "_far"))
    return out.withColumn("found", found).drop("_part", "_right", "_salt", "_near", "_far", "_key", "_c_part")


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """A row per revisit: record_id, canonical_url, ts, resolved_id, outcome, status, payload_digest,
    payload_length, headers.

    records: record_id, url, ts (epoch, long), kind ('response' or 'revisit'), status, etag,
    last_modified, payload_digest, payload_length, headers (map of lower-case names).
    outcome: 'resolved', 'validator_mismatch' (headers and body are not taken) or 'no_earlier'.
    """
    fields = ["record_id", "url", "ts", "kind", "status", "etag", "last_modified", "payload_digest", "payload_length", "headers"]
    rows = records.select(*fields).withColumn("canonical_url", canonical_url(F.col("url"))).drop("url")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    joined = as_of(rows, "canonical_url", "ts", "record_id", full, F.struct("record_id", "status", "etag", "last_modified", "payload_digest", "payload_length", "headers"), slices).where("kind = 'revisit'")
    f = F.col("found")
    differs = (F.col("etag") != f["etag"]) | (F.col("etag").isNull() & (F.col("last_modified") != f["last_modified"]))
    known = (F.col("etag").isNotNull() & f["etag"].isNotNull()) | (F.col("last_modified").isNotNull() & f["last_modified"].isNotNull())
    outcome = F.when(f.isNull(), "no_earlier").when(F.coalesce(differs, F.lit(False)) | ~known, "validator_mismatch").otherwise("resolved")
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(f["headers"], none), F.coalesce("headers", none)
    permitted = F.map_filter(new, lambda k, _: ~k.isin(*BODY_HEADERS))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    ok = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", F.when(ok, f["record_id"]).alias("resolved_id"), "outcome", F.when(ok, f["status"]).otherwise(F.col("status")).alias("status"),
        F.when(ok, f["payload_digest"]).alias("payload_digest"), F.when(ok, f["payload_length"]).alias("payload_length"), F.when(ok, merged).otherwise(new).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """A capture per page, of its site's section (the url up to the first part of its path, spelled in
    two ways): a third are full responses, the others not-modified records, two captures share a time,
    and a section's validators change every forty pages. So a record's response is another page's, of
    any earlier time and of either version; some records carry an entity tag, some a date, some
    neither. Nulls: a null page_id is a record without time or validators; a null url or html is
    allowed; repeated rows are captures of their own; an empty table gives no rows."""
    i, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    kind = F.when(i % 3 == 0, "response").otherwise("revisit")
    p = pages.select("page_id", F.concat(F.regexp_replace("url", "(?s)^([A-Za-z]+://[^/?#]*/[^/?#]*).*$", "$1"), F.when(i % 2 == 0, "/?utm_source=feed#top").otherwise("")).alias("url"), kind.alias("kind"), digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    first, version = F.col("kind") == "response", F.floor(i / 40).cast("string")
    etag = F.when(F.when(first, i % 4 != 0).otherwise(i % 5 < 3), F.concat(F.lit("v"), version))
    modified = F.when(F.when(first, i % 7 != 0).otherwise(i % 2 == 0), F.concat(F.lit("d"), version))
    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size").cast("string"), F.lit("etag"), etag, F.lit("age"), F.lit("0"))
    short = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), etag, F.lit("date"), F.col("page_id").cast("string"))
    return p.select(
        F.concat_ws("-", F.col("page_id").cast("string"), "kind").alias("record_id"), "url", F.floor(i / 2).alias("ts"), "kind", F.when(first, 200).otherwise(304).alias("status"), etag.alias("etag"), modified.alias("last_modified"),
        F.when(first, F.col("digest")).alias("payload_digest"), F.when(first, F.col("size")).alias("payload_length"), F.map_filter(F.when(first, full).otherwise(short), lambda _, x: x.isNotNull()).alias("headers"),
    )

"""Attribution URLs: slugs, building and reading tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard tags in the order in which they are written; what follows the prefix in an installation's own.
STANDARD, OWN = ("utm_source", "utm_campaign", "utm_content", "utm_term"), ("v", "lang", "run")
PREFIX = "tf_"


def slug(c: Column) -> Column:
    safe = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9._-]", "-")
    return F.lower(F.regexp_replace(F.regexp_replace(safe, "-{2,}", "-"), "^-+|-+$", ""))


def query_map(url: Column) -> Column:
    """Decoded parameters of a URL; of repeated names the first value."""
    text = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    decode = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%20")))
    entries = F.transform(pairs, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), decode(F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def parse(url: Column, prefix: str = PREFIX) -> Column:
    """struct of a tagged URL's attribution; null without utm_source. prefix: of the installation's own tags."""
    q = query_map(url)
    part = lambda name, default="": F.coalesce(F.try_element_at(q, F.lit(name)), F.lit(default))
    names = (("platform", "utm_source", ""), ("clip_id", "utm_content", ""), ("hook_type", "utm_term", ""), ("variant", f"{prefix}v", "a"), ("campaign", "utm_campaign", ""), ("run", f"{prefix}run", ""), ("lang", f"{prefix}lang", "tr"))
    return F.when(F.map_contains_key(q, "utm_source"), F.struct(*(part(tag, default).alias(name) for name, tag, default in names)))


def build(url: Column, platform: Column, clip_id: Column, hook_type: Column, variant: Column, campaign: Column, run: Column, lang: Column, prefix: str = PREFIX) -> Column:
    """The URL with its tags set: other parameters stay, empty tags are left out."""
    own = dict(zip((*STANDARD, *(prefix + k for k in OWN)), (slug(platform), slug(campaign), slug(clip_id), slug(hook_type), F.coalesce(F.nullif(slug(variant), F.lit("")), F.lit("a")), F.coalesce(F.nullif(slug(lang), F.lit("")), F.lit("tr")), slug(run)), strict=True))
    q = query_map(url)
    medium = {"utm_medium": F.lit("social_organic")}
    new = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in (own | medium).items())), lambda e: e["value"] != "")
    names = F.transform(new, lambda e: e["key"])
    kept = F.filter(F.map_entries(q), lambda e: ~F.array_contains(names, e["key"]))
    text = F.array_join(F.transform(F.concat(kept, new), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), text, F.regexp_extract(url, r"(#.*)$", 1))


def campaign_name(brand: Column, video: Column, month: Column) -> Column:
    return slug(F.concat(brand, F.lit("_clips_"), month, F.lit("_"), video))


def video_id(url: Column) -> Column:
    """The eleven-character id in a watch URL, else the start of the URL's hash."""
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found).otherwise(F.substring(F.sha1(url.cast("binary")), 1, 11))

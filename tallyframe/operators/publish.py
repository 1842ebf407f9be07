"""Checks of copy before publishing, and the requests that publishing would make."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Fixed values by platform: most characters, characters kept for the link, least and most hashtags.
SPECS = {"linkedin": (3000, 0, 3, 5), "instagram": (2200, 0, 8, 12), "x": (280, 24, 1, 2), "tiktok": (2200, 0, 3, 5), "youtube": (5000, 0, 3, 4)}
#: Fixed values by platform: characters of text and seconds of media allowed, whether media must be public, whether
#: it schedules by itself, and the aspects it takes. Media may have MEDIA_BYTES anywhere.
LIMITS = {
    "linkedin": (3000, 600.0, False, False, ("16:9", "1:1", "9:16")), "instagram": (2200, 90.0, True, False, ("9:16",)), "x": (280, 140.0, False, False, ("16:9", "1:1", "9:16")),
    "tiktok": (2200, 600.0, False, False, ("9:16",)), "youtube": (5000, 180.0, False, True, ("9:16",)),
}
MEDIA_BYTES = 512 << 20
#: Characters that a link takes in a text of x, and of a title of youtube.
LINK_CHARS, TITLE_CHARS = 24, 100
LINKED = ("linkedin", "x", "youtube")


def issue(when: Column, code: str, severity: str, detail: Column | str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def present(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _by(platform: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v))), platform)


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def missing_numbers(cited: Column, clip: Column) -> Column:
    """The cited numbers that the clip gives neither in digits nor in words: the clip is read once for all of them,
    and its words only where digits don't do."""
    bare = lambda t: F.regexp_replace(t, "[^0-9]", "")
    tokens = F.regexp_extract_all(F.coalesce(cited, F.lit("")), F.lit("[0-9][0-9.,]*"), 0)
    spelled = lambda left: _let(tx.spelled_numbers(clip), lambda s: F.filter(left, lambda t: ~F.array_contains(s, F.coalesce(bare(t).try_cast("bigint"), F.lit(-1).cast("bigint")))))
    left = _let(bare(clip), lambda digits: F.filter(tokens, lambda t: ~digits.contains(bare(t))))
    found = _let(left, lambda x: F.when(F.size(x) > 0, spelled(x)).otherwise(x))
    return F.when(F.size(tokens) > 0, found).otherwise(tokens)


def validate_copy(rows: DataFrame, banned: tuple[str, ...] = ()) -> DataFrame:
    """(clip_id, platform, issues) for rows (clip_id, platform, body, hashtags, evidence_quote, key_number, clip_text).

    Where the rows have a body_en that isn't blank, it is published by itself where the first of
    LINKED is, and passes that platform's gates of length, links and phrases."""
    quote, platform = tx.norm_ws(F.col("evidence_quote")), F.col("platform")
    words = F.size(F.filter(F.split(quote, " "), lambda w: w != ""))
    most, low, high = _by(platform, {k: v[0] - v[1] for k, v in SPECS.items()}), _by(platform, {k: v[2] for k, v in SPECS.items()}), _by(platform, {k: v[3] for k, v in SPECS.items()})
    length = F.length(F.when(platform == "x", tx.urls_as_23(F.col("body"))).otherwise(F.col("body")))
    rows = rows.withColumn("_gone", missing_numbers(F.col("key_number"), F.col("clip_text")))  # read twice below
    gone, tags = F.col("_gone"), F.size("hashtags")
    found = present(
        issue(words < 6, "EVIDENCE_TOO_SHORT", "error", F.concat(words.cast("string"), F.lit(" words"))),
        issue((words >= 6) & ~tx.norm_ws(F.col("clip_text")).contains(quote), "EVIDENCE_NOT_IN_TRANSCRIPT", "error", F.substring("evidence_quote", 1, 60)),
        issue(F.size(gone) > 0, "NUMBER_HALLUCINATION", "error", F.array_join(gone, ", ")),
        issue(length > most, "LEN_OVER", "error", F.concat_ws(" > ", length.cast("string"), most.cast("string"))),
        issue(platform.isin(*LINKED) & F.col("body").contains("http"), "LINK_IN_BODY", "error", "the link is appended later"),
        issue(~tags.between(low, high), "HASHTAG_COUNT", "warn", tags.cast("string")),
        *(issue(F.lower("body").contains(b.lower()), "BANNED_PHRASE", "error", b) for b in banned),
    )
    if "body_en" in rows.columns:
        en, (room, kept, *_) = F.trim("body_en"), SPECS[LINKED[0]]
        other = present(
            issue(F.length(en) > room - kept, "EN_LEN_OVER", "error", F.concat_ws(" > ", F.length(en).cast("string"), F.lit(str(room - kept)))),
            issue(en.contains("http"), "EN_LINK_IN_BODY", "error", "the link is appended later"),
            *(issue(F.lower(en).contains(b.lower()), "EN_BANNED_PHRASE", "error", b) for b in banned),
        )
        found = F.when(F.coalesce(en, F.lit("")) != "", F.concat(found, other)).otherwise(found)
    return rows.select("clip_id", "platform", found.alias("issues"))


def bilingual(rows: DataFrame) -> DataFrame:
    """Posts (clip_id, platform, lang, body, hashtags): each row's own, and where it has a body_en that
    isn't blank one more in English, on the first platform of LINKED alone."""
    own = F.struct(F.lit("tr").alias("lang"), F.col("body").alias("body"))
    en = F.when((F.col("platform") == LINKED[0]) & (F.coalesce(F.trim("body_en"), F.lit("")) != ""), F.struct(F.lit("en").alias("lang"), F.trim("body_en").alias("body")))
    return rows.select("clip_id", "platform", "hashtags", F.explode(F.filter(F.array(own, en), lambda x: x.isNotNull())).alias("x")).select("clip_id", "platform", "x.lang", "x.body", "hashtags")


def near_identical(rows: DataFrame, limit: float = 0.85) -> DataFrame:
    """(clip_id, a, b): platforms of a clip whose bodies share most three-word runs; at most ten pairs a clip."""
    g = rows.select("clip_id", "platform", tx.grams(F.split(tx.norm_ws(F.col("body")), " ")).alias("g"))
    both = g.alias("l").join(g.alias("r"), (F.col("l.clip_id") == F.col("r.clip_id")) & (F.col("l.platform") < F.col("r.platform")))
    return both.where(tx.jaccard(F.col("l.g"), F.col("r.g")) > limit).select(F.col("l.clip_id").alias("clip_id"), F.col("l.platform").alias("a"), F.col("r.platform").alias("b"))


def validate_request(rows: DataFrame) -> DataFrame:
    """(post_id, issues array of code, severity, detail) for rows (post_id, platform, text, bytes, duration_s, aspect,
    public_url, scheduled_at, and title and tracking_url if there are any), in the order of the checks.

    On x a link counts 23 characters wherever it stands and the tracking link LINK_CHARS; that check
    comes first there. youtube has a limit for titles and a quota a call, tiktok its review. A platform
    without limits has no issues; a null value is not checked, but a null aspect is unsupported.
    """
    p = F.col("platform")
    at = lambda i: _by(p, {k: v[i] for k, v in LIMITS.items()})
    title, link = (F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("title", "tracking_url"))
    said = F.coalesce(F.col("text"), F.lit(""))
    length = F.when(p == "x", F.length(tx.urls_as_23(said)) + F.when(F.coalesce(link, F.lit("")) != "", LINK_CHARS).otherwise(0)).otherwise(F.length(said))
    fits = _by(p, {k: ",".join(v[4]) for k, v in LIMITS.items()})
    found = present(
        issue(length > at(0), "TEXT_TOO_LONG", "error", F.concat_ws(" > ", length.cast("string"), at(0).cast("string"))),
        issue(~F.coalesce(F.array_contains(F.split(fits, ","), F.col("aspect")), F.lit(False)), "ASPECT_UNSUPPORTED", "warn", F.coalesce("aspect", F.lit("none"))),
        issue(F.col("bytes") > MEDIA_BYTES, "MEDIA_TOO_LARGE", "error", F.concat_ws(" > ", F.col("bytes").cast("string"), F.lit(str(MEDIA_BYTES)))),
        issue(F.col("duration_s") > at(1), "DURATION_TOO_LONG", "error", F.concat_ws(" > ", F.col("duration_s").cast("string"), at(1).cast("string"))),
        issue(at(2) & (F.coalesce(F.col("public_url"), F.lit("")) == ""), "PUBLIC_URL_REQUIRED", "error", "a public URL is needed"),
        issue(F.col("scheduled_at").isNotNull() & ~at(3), "NO_NATIVE_SCHEDULE", "warn", "held until due"),
        issue((p == "youtube") & (F.length(title) > TITLE_CHARS), "TITLE_TOO_LONG", "error", F.length(title).cast("string")),
        issue(p == "youtube", "QUOTA_COST", "warn", "an upload takes 1600 of 10000 units a day"),
        issue(p == "tiktok", "TIKTOK_UNAUDITED", "warn", "private until the app is reviewed"),
    )
    return rows.select("post_id", F.when(at(0).isNotNull(), found).otherwise(F.slice(found, 1, 0)).alias("issues"))


#: Fixed values by platform: the calls before the media, the parts' label, first number and bytes (no
#: number or bytes: the whole media in one call; no label: no upload), and the calls after.
PLANS = {
    "linkedin": (("initialize_upload",), ("upload_part_", 1, 4 << 20), ("finalize_upload", "create_post")),
    "instagram": (("check_publishing_limit", "create_container", "poll_container_status", "publish_container"), None, ()),
    "youtube": (("init_resumable_upload",), ("upload_bytes", None, None), ()),
    "x": (("media_init",), ("media_append_", 0, 5 << 20), ("media_finalize", "create_tweet")),
    "tiktok": (("query_creator_info", "init_video_publish"), ("upload_video", None, None), ("fetch_publish_status",)),
}


def platform_plan(rows: DataFrame) -> DataFrame:
    """(post_id, seq, label, from, length): the calls that publishing (post_id, platform, bytes) would
    make, in order. A platform without a plan makes none; of unknown bytes the parts are left out."""

    def calls(names) -> Column:
        kind = "array<struct<label:string,from:bigint,length:bigint>>"
        return F.array(*(F.struct(F.lit(x).alias("label"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("length")) for x in names)).cast(kind)

    def parts(label: str, first: int | None, size: int | None) -> Column:
        size = F.lit(size).cast("long") if size else F.greatest(F.col("bytes"), F.lit(1).cast("long"))
        n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("bytes") / size))
        name = lambda i: F.lit(label) if first is None else F.concat(F.lit(label), (i + first).cast("string"))
        each = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(name(i).alias("label"), (i * size).alias("from"), F.least(size, F.col("bytes") - i * size).alias("length")))
        return F.when(F.col("bytes").isNotNull(), each).otherwise(calls(()))

    plan = F.lit(None)
    for platform, (before, upload, after) in PLANS.items():
        own = F.concat(calls(before), parts(*upload), calls(after)) if upload else calls(before + after)
        plan = F.when(F.col("platform") == platform, own).otherwise(plan)
    return rows.select("post_id", F.posexplode(plan).alias("at", "c")).select("post_id", (F.col("at") + 1).alias("seq"), "c.*")


#: Headers that carry credentials, in lower case.
SECRET_HEADERS = ("authorization", "x-api-key", "profile-key", "cookie")


def redacted(headers: Column) -> Column:
    """Header values that carry credentials, hidden; the Bearer scheme stays."""
    secret = lambda k: F.lower(k).isin(*SECRET_HEADERS)
    return F.transform_values(headers, lambda k, v: F.when(secret(k) & v.startswith("Bearer "), "Bearer [REDACTED]").when(secret(k), "[REDACTED]").otherwise(v))


def sanitised(text: Column, secrets: dict[str, str]) -> Column:
    """Every credential's value, wherever it stands, as its name in angle brackets."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit(f"<{kv[0]}>")), ((k, s) for k, s in secrets.items() if s), text)


def missing_credentials(required: Column, present_names: Column) -> Column:
    return F.array_except(required, present_names)


def require_success_ratio(rows: DataFrame, ok: Column, least: float) -> DataFrame:
    """The rows, or an error while running where too few are ok; no attempts are fine."""
    share = rows.agg(F.count_if(ok).alias("_ok"), F.count("*").alias("_n"))
    gate = F.assert_true((F.col("_n") == 0) | (F.col("_ok") >= least * F.col("_n")), F.lit(f"success ratio below {least}"))
    return rows.crossJoin(F.broadcast(share)).where(gate.isNull()).drop("_ok", "_n")  # one row

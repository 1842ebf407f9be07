"""Metrics as an API answers them: responses to typed fields, merged by precedence, with what went wrong.

A response is a row (post_id, window, call, body, duration_s): call is `core` (named columns and one row),
`retention` (points of time share and watch share) or `lifetime` (counters of items). Nothing is fetched
here: bodies come from a log of responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_binary
from .timeseries import interpolate

#: Shape of any of the three bodies; numbers are read as their text.
BODY = "columnHeaders array<struct<name:string>>, rows array<array<string>>, items array<struct<statistics:struct<likeCount:string,commentCount:string>>>"
#: The API's column names and the fields they fill, whole numbers first.
COUNTS = {"views": "views", "likes": "likes", "comments": "comments", "shares": "shares"}
SHARES = {"averageViewDuration": "avg_view_duration_s", "averageViewPercentage": "completion_rate", "annotationClickThroughRate": "ctr"}
LIFETIME = {"likeCount": "likes", "commentCount": "comments"}
#: Seconds at which retention counts as the hook's.
HOOK_S = 3.0
FIELDS = (*COUNTS.values(), *SHARES.values(), "engagement_rate", "retention_curve", "hook_retention_3s", "dropoff_3s")


def named_value(body: Column, name: str) -> Column:
    """The value under a column's name in the first row of a response; of columns of one name the last
    counts, and names beyond the row's length, or values beyond the names', are nothing."""
    names, row = F.transform(body["columnHeaders"], lambda h: h["name"]), F.get(body["rows"], F.lit(0))
    n = F.least(F.size(names), F.size(row))
    at = F.array_position(F.reverse(F.slice(names, 1, F.greatest(n, F.lit(0)))), name)
    return F.when(at > 0, F.get(row, (n - at).cast("int")))


def whole(text: Column) -> Column:
    """Number text as a whole number, what is behind the point cut off; null if it is no number."""
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def _bad(texts: list[Column]) -> Column:
    """Whether one of the values is there but is no number."""
    bad = F.lit(False)
    for t in texts:
        bad = bad | (t.isNotNull() & t.try_cast("double").isNull())
    return bad


def core(rows: DataFrame) -> DataFrame:
    """Adds a core answer's fields, and bad where a named value is no number."""
    seen = {x: F.col(f"v_{x}") for x in (*COUNTS, *SHARES)}
    r = rows.withColumns({f"v_{x}": named_value(F.col("body"), x) for x in seen})
    r = r.withColumns({field: whole(seen[x]) for x, field in COUNTS.items()})
    acts = sum((F.coalesce(F.col(x), F.lit(0)) for x in ("comments", "shares")), F.coalesce("likes", F.lit(0)))
    r = r.withColumns({
        "avg_view_duration_s": seen["averageViewDuration"].try_cast("double"), "share": seen["averageViewPercentage"].try_cast("double") / 100.0, "clicks": seen["annotationClickThroughRate"].try_cast("double"),
        "acts": acts.cast("double") / F.nullif("views", F.lit(0)).cast("double"), "bad": _bad(list(seen.values())),
    })
    # rounded as elements: as three expressions of a row they make one method too long to be compiled
    r = r.withColumns({"completion_rate": round_binary(F.col("share"), 4), "rates": F.transform(F.array("clicks", "acts"), lambda x: round_binary(x, 5))})
    return r.withColumns({"ctr": F.get("rates", F.lit(0)), "engagement_rate": F.get("rates", F.lit(1))}).drop(*(f"v_{x}" for x in seen), "share", "clicks", "acts", "rates")


def retention(rows: DataFrame) -> DataFrame:
    """Adds the curve in seconds, the share still watching at HOOK_S and the share lost by then; nothing
    for a post without length."""
    number = lambda r, i: F.get(r, F.lit(i)).try_cast("double")
    points = F.when((F.col("duration_s") > 0) & (F.size("body.rows") > 0), F.transform("body.rows", lambda r: F.struct(number(r, 0).alias("x"), number(r, 1).alias("y"))))
    r = rows.withColumn("points", points).withColumn("sorted", F.sort_array("points"))
    r = r.withColumn("share", interpolate(F.col("sorted"), HOOK_S / F.nullif("duration_s", F.lit(0.0))))
    curve = F.transform("points", lambda p: F.struct(round_binary(p["x"] * F.col("duration_s"), 2).alias("x"), round_binary(p["y"], 4).alias("y")))
    bad = F.coalesce(F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull()), F.lit(False))
    return r.withColumns({"retention_curve": curve, "hook_retention_3s": round_binary(F.col("share"), 4), "dropoff_3s": F.when(F.col("share").isNotNull(), round_binary(F.greatest(F.lit(0.0), 1.0 - F.col("share")), 4)), "bad": bad}).drop("points", "sorted", "share")


def lifetime(rows: DataFrame) -> DataFrame:
    """Adds the counters of the first item."""
    s = F.get("body.items", F.lit(0))["statistics"]
    return rows.withColumns({field: whole(s[x]) for x, field in LIFETIME.items()} | {"bad": _bad([s[x] for x in LIFETIME])})


#: Calls by precedence: a field of an earlier one is not overwritten by a later one's.
CALLS = {"core": core, "retention": retention, "lifetime": lifetime}


def parse_responses(responses: DataFrame) -> DataFrame:
    """(post_id, window, FIELDS, errors): one row a post and window.

    Fields of the core call come before those of retention, those before lifetime counters: a counter
    fills only what the window's own answer lacks. A response that is no JSON, or has a value that is
    no number, costs its call's fields and leaves `call: reason` in errors (sorted; empty if all went
    well). An answer without rows has no fields and is no error. Of repeated answers to a call each
    field's largest value counts. Null post or window: a group of its own. An unknown call is ignored.
    """
    rows = responses.where(F.col("call").isin(*CALLS)).select("post_id", "window", "call", F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0)).alias("duration_s"), F.try_parse_json("body").isNull().alias("broken"), F.from_json("body", BODY, {"mode": "PERMISSIVE"}).alias("parsed"))
    # Every answer is read once and passes all calls: at another call's it has no body. Its fields stand in a structure
    # of its call, so while rows wait for their groups none has room for another call's; what went wrong is a bit.
    flat, kinds, bits = rows, {}, {}
    for call, add in CALLS.items():
        mine = F.col("call") == call
        before = flat.columns
        flat = add(flat.withColumn("body", F.when(mine, F.col("parsed"))))
        fields = [c for c in flat.columns if c in FIELDS]
        not_json, not_a_number = (bits.setdefault(f"{call}: {reason}", 1 << len(bits)) for reason in ("not JSON", "not a number"))
        flat = flat.withColumn(f"{call}_wrong", F.when(mine & F.col("broken"), not_json).when(mine & F.col("bad"), not_a_number))
        good = mine & F.col(f"{call}_wrong").isNull()
        flat = flat.select(*before, f"{call}_wrong", F.when(good, F.struct(*fields)).alias(f"{call}_fields"))
        for f in fields:
            kinds.setdefault(f, []).append(f"{call}_fields.{f}")
    flat = flat.select("post_id", "window", *(f"{call}_fields" for call in CALLS), F.coalesce(*(f"{call}_wrong" for call in CALLS)).alias("wrong"))
    merged = flat.groupBy("post_id", "window").agg(*(F.max(c).alias(c) for cs in kinds.values() for c in cs), F.bit_or("wrong").alias("wrong"))
    errors = F.array_compact(F.array(*(F.when(F.col("wrong").bitwiseAND(bits[x]) > 0, x) for x in sorted(bits))))
    return merged.select("post_id", "window", *(F.coalesce(*(F.col(f"`{c}`") for c in kinds[f])).alias(f) for f in FIELDS), errors.alias("errors"))


def collected_share(parsed: DataFrame) -> DataFrame:
    """parsed with n_measured, the number of fields that a call has measured, and provenance: REAL if all
    single numbers are there, SIMULATED if none is, else MIXED."""
    numbers = [f for f in FIELDS if f != "retention_curve"]
    n = sum((F.col(f).isNotNull().cast("int") for f in numbers[1:]), F.col(numbers[0]).isNotNull().cast("int"))
    return parsed.withColumn("n_measured", n).withColumn("provenance", F.when(n == len(numbers), "REAL").when(n == 0, "SIMULATED").otherwise("MIXED"))

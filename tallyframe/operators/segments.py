"""Segmentation of timed rows: boundaries, islands, merging, splitting and candidate runs.

Windows are partitioned by one document, conversation or user: the unit whose order they follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .folds import cut_islands, folded


def boundaries(words: DataFrame, by: str, gap_s: float = 0.65, speaker: str | None = None, following: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, word_index, t, reason, keep): a boundary before each word that follows final punctuation, a
    pause of gap_s, or a change of speaker; the first of these names it.

    following: the column with the next word's start, where the rows have it; then only boundaries are shuffled."""
    w = Window.partitionBy(by).orderBy("pos")
    token = F.trim("w")
    ends = token.rlike("[.?!…]$") & ~tx.is_abbreviation(token)
    after = F.col(following) if following else F.lead("start").over(w)
    pause = (after - F.col("end") >= gap_s - 1e-5) & (F.round(after - F.col("end"), 6) >= gap_s)  # few are near enough to be rounded
    reason = F.when(ends, "punctuation").when(pause, "pause")
    if speaker:
        reason = reason.when(F.lead(speaker).over(w) != F.col(speaker), "speaker_change")
    marked = words.withColumn("t", after).withColumn("reason", reason)
    mark = F.col("t").isNotNull() & F.col("reason").isNotNull()
    if following:
        numbered = marked.where(mark).withColumn("id", F.row_number().over(w) - 1)
    else:
        numbered = marked.withColumn("id", F.count_if(mark).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where(mark)  # the same order: one sort
    return numbered.select(by, (F.col("pos") + 1).alias("word_index"), "t", "reason", F.col("id").cast("int").alias("id"), *keep)


def islands(rows: DataFrame, by: str, order: list[str], starts: Column, name: str) -> DataFrame:
    """Adds a running number that grows at each row where `starts` holds."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def merge_short(segments: DataFrame, by: str, min_s: float) -> DataFrame:
    """Segments shorter than min_s join the one before them: (by, seg, start, end, text, word_count)."""
    first = F.row_number().over(Window.partitionBy(by).orderBy("seg")) == 1
    marked = segments.withColumn("_first", first)
    isles = islands(marked, by, ["seg"], F.col("_first") | (F.round(F.col("end") - F.col("start"), 6) >= min_s), "isle")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), " ")
    g = isles.groupBy(by, "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text"), F.sum("word_count").alias("word_count"))
    return g.select(by, (F.col("isle") - 1).alias("seg"), "start", "end", "text", "word_count")


def split_long(segments: DataFrame, by: str, max_s: float) -> DataFrame:
    """Segments longer than max_s in equal pieces; each takes whole words, the remainder goes."""
    span = F.round(F.col("end") - F.col("start"), 6)
    pieces = F.when(span <= max_s, 1).otherwise(F.floor(span / max_s) + 1).cast("int")
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    s = segments.withColumn("pieces", pieces).withColumn("tokens", tokens).withColumn("per", F.when(F.col("pieces") == 1, F.col("word_count")).otherwise(F.greatest(F.lit(1), F.floor(F.col("word_count") / F.col("pieces")))).cast("int"))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    step = (F.col("end") - F.col("start")) / F.col("pieces")
    text = F.when(F.col("pieces") == 1, F.col("text")).otherwise(F.array_join(F.slice("tokens", F.col("k") * F.col("per") + 1, F.col("per")), " "))
    return s.select(by, "seg", "k", F.round(F.col("start") + F.col("k") * step, 3).alias("start"), F.round(F.least("end", F.col("start") + (F.col("k") + 1) * step), 3).alias("end"), text.alias("text"), F.col("per").cast("long").alias("word_count"))


def dedupe_gap(rows: DataFrame, by: str, min_gap: float) -> DataFrame:
    """Of marks closer than min_gap to the last kept one, the one with more votes stays in its place:
    (by, id, t, votes). Nothing carries over a pause longer than min_gap, so a group is folded by
    islands, in streams that hold one mark. A null vote loses to any; a null group is one of its own;
    marks without a time are left out; repeated rows are marks of their own."""
    types = dict(rows.dtypes)
    typed = rows.where("t is not null").select(by, F.col("t").cast("double").alias("t"), F.col("id").cast("long").alias("id"), F.col("votes").cast("long").alias("votes"))

    def step(state: dict, row: tuple):
        group, _, t, mark, votes = row
        votes = None if votes is None or votes != votes else int(votes)
        last = state.get("last")
        state["last"] = (group, int(mark), t, votes)
        if last is None:
            return ()
        if t - last[2] >= min_gap:
            return (last,)
        if votes is None or last[3] is not None and votes <= last[3]:
            state["last"] = last
        return ()

    isles = cut_islands(typed, by, F.col("t"), min_gap).select(by, "island", "t", "id", "votes")
    return folded(isles, [by, "island"], ["t", "id"], dict, step, lambda state: (state["last"],), f"{by} {types[by]}, id long, t double, votes long")


def overlapping_windows(duration: Column, core: float, context: float) -> Column:
    """Array of (window, from, to, core_from, core_to) covering a duration."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(duration / core).cast("int") - 1))
    return F.transform(starts, lambda i: F.struct(i.alias("window"), F.greatest(F.lit(0.0), i * core - context).alias("from"), F.least(duration, (i + 1) * core + context).alias("to"), (i * core).alias("core_from"), F.least(duration, (i + 1) * core).alias("core_to")))


def in_windows(rows: DataFrame, at: str, duration: str, core: float, context: float) -> DataFrame:
    """rows by each of overlapping_windows(duration) that holds their time: the few around it, no join."""
    last = F.greatest(F.lit(0), F.ceil(F.col(duration) / core).cast("int") - 1)
    i = F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - context) / core).cast("int")), F.least(last, F.floor((F.col(at) + context) / core).cast("int")))
    r = rows.select("*", F.explode(i).alias("window")).withColumns({"core_from": F.col("window") * core, "core_to": F.least(F.col(duration), (F.col("window") + 1) * core)})
    held = (F.col(at) >= F.greatest(F.lit(0.0), F.col("core_from") - context)) & (F.col(at) < F.least(F.col(duration), (F.col("window") + 1) * core + context))
    return r.where(held)


def tiles(marks: DataFrame, spans: DataFrame, by: str, least_s: float = 1.0, sparse_s: float = 20.0, sparse_words: int = 15) -> DataFrame:
    """(by, seg, start, end, first_word, n_words): the time from a unit's first word to its end, cut at
    its marks (by, word_index, t). Tiles shorter than least_s go, and those longer than sparse_s with
    fewer than sparse_words words; the others are numbered. spans: (by, origin, duration, n_words)."""
    cuts = marks.select(by, F.col("word_index").cast("long").alias("first_word"), F.col("t").cast("double").alias("start"))
    edges = spans.select(by, F.lit(0).cast("long").alias("first_word"), F.col("origin").cast("double").alias("start")).unionByName(cuts)
    w = Window.partitionBy(by).orderBy("first_word", "start")
    own = spans.select(by, F.col("duration").cast("double").alias("_end"), F.col("n_words").cast("long").alias("_words"))
    t = edges.withColumn("end", F.lead("start").over(w)).withColumn("to", F.lead("first_word").over(w)).join(own, by)
    t = t.select(by, "start", F.coalesce("end", "_end").alias("end"), "first_word", (F.coalesce("to", "_words") - F.col("first_word")).alias("n_words"))
    long = F.round(F.col("end") - F.col("start"), 6)
    kept = t.where((long >= least_s) & ~((long > sparse_s) & (F.col("n_words") < sparse_words)))
    return kept.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("first_word", "start")) - 1).cast("long").alias("seg"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "first_word", "n_words")


def locate(units: DataFrame, wanted: DataFrame, by: str, least: float = 0.4, most: int = 3) -> DataFrame:
    """(by, unit, confidence): where the wanted words (by, wanted) stand among units (by, unit, tokens):
    the unit with the highest recall, if it reaches `least`; else, of the runs of up to `most` units,
    the one of the highest recall, and in it the unit with the highest of its own. Ties go to the
    earlier and the shorter; a group whose words are found nowhere has no row."""
    w = Window.partitionBy(by).orderBy("unit").rowsBetween(0, most - 1)
    j = units.join(wanted.select(by, F.array_distinct("wanted").alias("wanted")), by).where(F.size("wanted") > 0)
    part = lambda c: F.size(F.array_intersect("wanted", c)) / F.size("wanted")
    own = j.withColumn("single", part(F.col("tokens"))).withColumn("ahead", F.collect_list(F.struct("unit", "single", "tokens")).over(w))
    runs = F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda n: F.slice("ahead", F.lit(1), n))
    rated = F.transform(runs, lambda r: F.struct(
        part(F.flatten(F.transform(r, lambda x: x["tokens"]))).alias("recall"), (-F.size(r)).alias("shorter"),
        F.array_max(F.transform(r, lambda x: F.struct(x["single"].alias("single"), (-x["unit"]).alias("at"))))["at"].alias("at"),
    ))
    best = own.select(by, "unit", "single", F.array_max(rated).alias("run"))
    g = best.groupBy(by).agg(F.max(F.struct("single", -F.col("unit"))).alias("one"), F.max(F.struct(F.col("run.recall").alias("recall"), (-F.col("unit")).alias("first"), F.col("run.shorter").alias("shorter"), F.col("run.at").alias("at"))).alias("many"))
    alone = F.col("one.single") >= least
    found = g.select(by, F.when(alone, -F.col("one.col2")).otherwise(-F.col("many.at")).alias("unit"), F.round(F.when(alone, F.col("one.single")).otherwise(F.col("many.recall")), 3).alias("confidence"))
    return found.where(F.col("confidence") >= F.round(F.lit(least), 3))


def opening_windows(units: DataFrame, found: DataFrame, by: str, min_s: float, max_s: float, lead_in_s: float = 2.5) -> DataFrame:
    """(by, first, last, start, end, fraction, score): runs of units (by, unit, start, end) that open on
    the unit found (by, unit, confidence, total, span) or, where that costs at most lead_in_s, on the
    one before it, and last from min_s to max_s. Opening on it exactly adds three."""
    w = Window.partitionBy(by).orderBy("unit")
    begin = units.select(by, "unit", "start", F.lag("unit").over(w).alias("before"), F.lag("start").over(w).alias("before_start"))
    hit = found.join(begin, [by, "unit"])
    near = F.col("before").isNotNull() & (F.round(F.col("start") - F.col("before_start"), 6) <= lead_in_s)
    opens = F.filter(F.array(F.struct(F.col("unit").alias("first"), F.col("start").alias("start"), F.lit(True).alias("exact")), F.struct(F.col("before").alias("first"), F.col("before_start").alias("start"), F.lit(False).alias("exact"))), lambda x: x["exact"] | near)
    s = hit.select(by, "confidence", "total", "span", F.explode(opens).alias("o")).select(by, "confidence", "total", "span", "o.*")
    j = s.join(units.select(by, F.col("unit").alias("last"), F.col("end").alias("end")), by).where((F.col("last") >= F.col("first")) & F.round(F.col("end") - F.col("start"), 6).between(min_s, max_s))
    fraction = F.least(F.lit(1.0), (F.col("end") - F.col("start")) / F.greatest(F.lit(1e-6), F.col("span")))
    score = F.col("total") * F.sqrt(fraction) * (0.75 + 0.25 * F.col("confidence")) + F.when(F.col("exact"), 3.0).otherwise(0.0)
    return j.select(by, "first", "last", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round(fraction, 3).alias("fraction"), F.round(score, 2).alias("score"))


def candidate_runs(units: DataFrame, by: str, min_s: float, max_s: float, text: bool = True) -> DataFrame:
    """All runs of adjacent units whose span lies in [min_s, max_s]: (by, first, last, start, end, and text).

    A run is found from its first unit's row and the units that start within max_s of it, however
    many they are. Only their numbers and times are carried; the texts of the runs found are joined last,
    and not at all without `text`.
    """
    w = Window.partitionBy(by).orderBy(F.floor(F.col("start") * 1000)).rangeBetween(0, int(max_s * 1000) + 1)
    near = F.filter(F.array_sort(F.collect_list(F.struct("unit", "start", "end")).over(w)), lambda x: x["unit"] >= F.col("unit"))
    last = F.filter(F.col("ahead"), lambda x: F.round(x["end"] - F.col("start"), 6).between(min_s, max_s))
    runs = units.select(by, "unit", "start", near.alias("ahead")).select(by, F.col("unit").alias("first"), "start", F.explode(last).alias("x"))
    runs = runs.select(by, "first", F.col("x.unit").alias("last"), "start", F.col("x.end").alias("end"))
    if not text:
        return runs
    own = units.select(F.col(by).alias("_by"), F.col("unit").alias("_unit"), "text")
    each = runs.withColumn("_at", F.explode(F.sequence("first", "last"))).join(own, (F.col(by) == F.col("_by")) & (F.col("_at") == F.col("_unit")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_unit", "text"))), lambda x: x["text"]), " ")
    return each.groupBy(by, "first", "last", "start", "end").agg(said.alias("text"))


def fill_from_pauses(marks: DataFrame, failed: DataFrame, by: str, every_s: float = 90.0) -> DataFrame:
    """Marks for windows (by, window, from, to) that have none: of their pauses (by, id, t, reason) every
    step-th, so that about one remains per every_s."""
    j = marks.where("reason = 'pause'").join(failed, by).where("t >= `from` and t < `to`")
    w = Window.partitionBy(by, "window")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / F.greatest(F.lit(1), F.floor((F.col("to") - F.col("from")) / every_s))))
    return j.withColumn("step", step).withColumn("rn", F.row_number().over(w.orderBy("t", "id")) - 1).where("rn % step = 0").select(by, "window", "id", "t")

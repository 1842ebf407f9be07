"""Caption text: balanced wrapping, timestamps, colours, and one event per word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wrap(words: Column, width: int, lines: int) -> Column:
    """Array of at most `lines` lines: words fill a line up to the width, the last line takes the rest. No word is dropped."""
    start = F.array().cast("array<string>")

    def step(acc: Column, w: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(last, F.lit(" "), w)
        fits = (F.size(acc) > 0) & ((F.length(joined) <= width) | (F.size(acc) >= lines))
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.array_append(acc, w))

    return F.aggregate(words, start, step)


def wrap_cut(words: Column, width: int, lines: int) -> Column:
    """Array of the first `lines` lines of the same filling: a cover's title, what doesn't fit goes. The words have no
    blanks, so a line is what a pattern takes: the most up to the width that ends with a word, or one longer word."""
    line = rf"(?:[^ ].{{0,{width - 1}}}(?= |$)|[^ ]+)"
    top = F.regexp_extract(F.array_join(words, " "), rf"(?s)^{line}(?: {line}){{0,{lines - 1}}}", 0)
    return F.regexp_extract_all(top, F.lit(f"(?s){line}"), 0)


def timestamp(seconds: Column) -> Column:
    c = F.round(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


def colour(rgb: Column) -> Column:
    """#RRGGBB as the caption format's &HAABBGGRR."""
    h = F.upper(F.regexp_replace(rgb, "^#", ""))
    return F.concat(F.lit("&H00"), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def word_events(words: DataFrame, by: str, group: int = 6, mark: str = "&H0000FFFF") -> DataFrame:
    """(by, pos, line): for each word (by, pos, w, start, end) an event that shows its group with the word marked."""
    w = Window.partitionBy(by, "chunk").orderBy("pos")
    every = Window.partitionBy(by, "chunk")
    t = words.withColumn("chunk", F.floor(F.col("pos") / group)).withColumn("shown", F.array_sort(F.collect_list(F.struct("pos", "w")).over(every)))
    until = F.coalesce(F.lead("start").over(w), F.col("end"))
    text = F.array_join(F.transform("shown", lambda x: F.when(x["pos"] == F.col("pos"), F.concat(F.lit("{\\c" + mark + "}"), x["w"], F.lit("{\\r}"))).otherwise(x["w"])), " ")
    return t.select(by, "pos", F.concat_ws(",", F.lit("Dialogue: 0"), timestamp(F.col("start")), timestamp(until), F.lit("Default,,0,0,0"), F.lit(""), text).alias("line"))

"""Caption documents: a clip's words as the lines of its file, and a cover's document.

caption_lines(rows, clock) takes clips that are a row each; the table function takes words that are rows:

    register(spark)
    spark.sql("SELECT * FROM caption_lines(TABLE(words) PARTITION BY clip ORDER BY pos)")
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from ..functions import text as tx
from .captions import wrap, wrap_cut

#: Sizes by aspect (frame, font, margins below and beside, hook font and place, characters a line, outline).
LAYOUTS = {
    "9:16": {"frame": (1080, 1920), "font": 74, "below": 420, "beside": 90, "hook_font": 96, "hook_at": (540, 760), "width": 18, "outline": 5},
    "16:9": {"frame": (1920, 1080), "font": 54, "below": 90, "beside": 120, "hook_font": 72, "hook_at": (960, 380), "width": 34, "outline": 4},
}
#: The head of a document; {} are the fields below.
HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: {w}
PlayResY: {h}
WrapStyle: 2
ScaledBorderAndShadow: yes
YCbCr Matrix: TV.709

[V4+ Styles]
Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding
Style: Base,{face},{font},{paper},{paper},{ink},&H80000000,0,0,0,0,100,100,0.6,0,1,{outline},2,2,{beside},{beside},{below},1
Style: Hook,{face},{hook_font},{paper},{paper},{ink},&HA0000000,0,0,0,0,100,100,1.0,0,1,{hook_outline},3,5,80,80,0,1

[Events]
Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text"""
#: The head of a cover's document.
COVER_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: {w}
PlayResY: {h}
WrapStyle: 2
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Cover,{face},{font},{paper},{accent},{ink},{ink},-1,0,0,0,100,100,0,0,1,{outline},2,5,{beside},{beside},0,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"""
#: Colours, typeface, words an event shows, lines of text, the hook's seconds and the least length of an event.
PAPER, INK, ACCENT, FACE, GROUP, LINES, HOOK_S, LEAST_S = "#ffffff", "#101010", "#ffff00", "Segoe UI Black", 6, 3, 3.2, 0.04


def _colour(rgb: str) -> str:
    h = rgb.removeprefix("#").upper()
    return f"&H00{h[4:6]}{h[2:4]}{h[:2]}"


def _head(x: dict) -> str:
    return HEAD.format(w=x["frame"][0], h=x["frame"][1], face=FACE, font=x["font"], paper=_colour(PAPER), ink=_colour(INK), outline=x["outline"], beside=x["beside"], below=x["below"], hook_font=x["hook_font"], hook_outline=x["outline"] + 1)


def _hook(x: dict) -> str:
    """A hook's event up to its text."""
    return f"Dialogue: 1,{_clock(0)},{_clock(HOOK_S)},Hook,,0,0,0,,{{\\fad(180,260)\\pos({x['hook_at'][0]},{x['hook_at'][1]})}}"


def _clock(seconds: float) -> str:
    c = int(seconds * 100 + 0.5)
    return f"{c // 360000}:{c // 6000 % 60:02d}:{c // 100 % 60:02d}.{c % 100:02d}"


def _upper(text: str) -> str:
    return text.translate({ord("i"): "İ", ord("ı"): "I"}).upper()


def filled(lengths: list[int], width: int, lines: int) -> list[list[int]]:
    """Numbers of words, line by line: a word that no longer fits opens a line, as long as one is left."""
    out, used = [], 0
    for i, n in enumerate(lengths):
        if out and (used + 1 + n <= width or len(out) == lines):
            out[-1].append(i)
            used += 1 + n
        else:
            out.append([i])
            used = n
    return out


def shown(tokens: list[str], width: int, lines: int = LINES) -> str:
    return "\\N".join(" ".join(tokens[i] for i in line) for line in filled([len(x) for x in tokens], width, lines))


@udtf(returnType="clip string, seq int, line string")
class CaptionLines:
    """(clip, seq, line): a document's lines in order, for the words (clip, w, start, end, aspect, hook) of one
    partition in the order of its rows.

    The head comes first, then the hook if there is one, then an event a word that shows its group of
    GROUP words with the word in the accent colour. Only one group of words is held. A null word is
    empty; a null start or end is 0, and an event lasts LEAST_S at least; an unknown or null aspect is
    9:16. Without rows there is no document.
    """

    def __init__(self) -> None:
        self.clip, self.layout, self.seq, self.group = None, None, 0, []

    def _say(self, line: str) -> tuple:
        self.seq += 1
        return self.clip, self.seq, line

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.layout is None:
            self.clip = None if row["clip"] is None else str(row["clip"])
            self.layout = x = LAYOUTS.get(row["aspect"], LAYOUTS["9:16"])
            for line in _head(x).split("\n"):
                yield self._say(line)
            if row["hook"]:
                text = shown(_upper(row["hook"]).split(), x["width"] - 2)
                yield self._say(f"{_hook(x)}{text}")
        self.group.append((_upper(row["w"] or ""), row["start"] or 0.0, row["end"] or 0.0))
        if len(self.group) == GROUP:
            yield from self._flush()

    def terminate(self) -> Iterator[tuple]:
        yield from self._flush()

    def _flush(self) -> Iterator[tuple]:
        tokens, on, off = [g[0] for g in self.group], _colour(ACCENT), _colour(PAPER)
        lines = filled([len(x) for x in tokens], self.layout["width"], LINES) if tokens else []
        for k, (_, start, end) in enumerate(self.group):
            text = "\\N".join(" ".join(f"{{\\c{on}}}{tokens[i]}{{\\c{off}}}" if i == k else tokens[i] for i in line) for line in lines)
            begin = max(0.0, start)
            yield self._say(f"Dialogue: 0,{_clock(begin)},{_clock(max(begin + LEAST_S, end))},Base,,0,0,0,,{text}")
        self.group = []


def register(spark: SparkSession) -> None:
    spark.udtf.register("caption_lines", CaptionLines)


def _stamp(c: Column) -> Column:
    """Hundredths of a second as a time; the column is read four times, so it should be no expression."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(c / 360000).cast("string"), F.lit(":"), two(F.floor(c / 6000) % 60), F.lit(":"), two(F.floor(c / 100) % 60), F.lit("."), two(c % 100))


def caption_lines(rows: DataFrame, clock: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """(clip, seq, line): what the table function gives, for rows (clip, tokens, aspect, hook) of a clip each,
    where clock(place) is when a word starts and ends. No row meets another, so nothing is shuffled.

    tokens are the clip's words in capitals, none of them null; a clip without any has no document.
    """
    aspect = F.when(F.col("aspect").isin(*LAYOUTS), F.col("aspect")).otherwise("9:16")
    by = lambda f: F.coalesce(*(F.when(F.col("aspect") == a, f(x)) for a, x in LAYOUTS.items()))
    said = F.filter(F.split(tx.tr_upper(F.col("hook")), r"(?U)\s+"), lambda w: w != "")
    hook = by(lambda x: F.concat(F.lit(_hook(x)), F.array_join(wrap(said, x["width"] - 2, LINES), "\\N")))
    hooked = F.coalesce(F.col("hook"), F.lit("")) != ""
    head = by(lambda x: F.array(*map(F.lit, _head(x).split("\n"))))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / GROUP).cast("int")), lambda i: F.slice("tokens", i * GROUP + 1, GROUP))
    r = rows.where(F.size("tokens") > 0).withColumn("aspect", aspect).select("clip", by(lambda x: F.lit(x["width"])).alias("width"), F.when(hooked, F.array_append(head, hook)).otherwise(head).alias("head"), groups.alias("groups"))
    r = r.select("clip", "width", F.size("head").alias("before"), F.posexplode(F.concat(F.array("head"), F.col("groups"))).alias("g", "ws"))  # the head is the first group
    first = F.get("ws", F.lit(0))
    r = r.withColumns({"lines": F.lit(1), "used": F.length(first), "seps": F.array(F.lit("")), "parts": F.array(first)})
    for k in range(1, GROUP):  # a group has so few words that the filling needs no fold
        w, n = F.get("ws", F.lit(k)), F.length(F.get("ws", F.lit(k)))
        r = r.withColumn("fits", (F.col("used") + 1 + n <= F.col("width")) | (F.col("lines") == LINES)).withColumn("sep", F.when(F.col("fits"), " ").otherwise("\\N"))
        r = r.withColumns({"seps": F.array_append("seps", F.col("sep")), "parts": F.array_append("parts", F.concat("sep", w)), "lines": F.col("lines") + F.when(F.col("fits"), 0).otherwise(1), "used": F.when(F.col("fits"), F.col("used") + 1 + n).otherwise(n)})
    r = r.select("clip", "g", "before", "seps", "parts", F.posexplode("ws").alias("k", "w"))
    at = (F.col("g") - 1) * GROUP + F.col("k")
    start, _ = clock(F.col("at"))
    r = r.withColumn("at", at).withColumn("start", F.greatest(F.lit(0.0), F.coalesce(start, F.lit(0.0)))).withColumn("end", F.coalesce(clock(F.col("at"))[1], F.lit(0.0)))
    cs = lambda x: F.floor(x * 100 + 0.5)
    r = r.withColumns({"on": cs(F.col("start")), "off": cs(F.greatest(F.col("start") + LEAST_S, "end"))})  # steps: each is worked out once
    text = F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ""), F.get("seps", F.col("k")), F.lit(f"{{\\c{_colour(ACCENT)}}}"), "w", F.lit(f"{{\\c{_colour(PAPER)}}}"), F.array_join(F.slice("parts", F.col("k") + 2, F.lit(GROUP)), ""))
    event = F.concat(F.lit("Dialogue: 0,"), _stamp(F.col("on")), F.lit(","), _stamp(F.col("off")), F.lit(",Base,,0,0,0,,"), text)
    top = F.col("g") == 0
    return r.select("clip", F.when(top, F.col("k") + 1).otherwise(F.col("before") + F.col("at") + 1).alias("seq"), F.when(top, F.col("w")).otherwise(event).alias("line"))


def cover_document(hook: Column, aspect: str = "9:16", accent: str = ACCENT) -> Column:
    """A cover's whole document: the hook in capitals, cut after LINES lines. A null hook has none."""
    x = LAYOUTS[aspect]
    size, y = int(x["hook_font"] * 1.12), int(x["frame"][1] * (0.74 if aspect == "9:16" else 0.78))
    head = COVER_HEAD.format(w=x["frame"][0], h=x["frame"][1], face=FACE, font=size, paper=_colour(PAPER), accent=_colour(accent), ink=_colour(INK), outline=x["outline"] + 2, beside=x["beside"])
    words = F.filter(F.split(tx.tr_upper(hook), r"\s+"), lambda w: w != "")
    event = f"Dialogue: 0,0:00:00.00,0:00:05.00,Cover,,0,0,0,,{{\\pos({x['frame'][0] // 2},{y})}}"
    return F.concat(F.lit(f"{head}\n{event}"), F.array_join(wrap_cut(words, x["width"], LINES), "\\N"), F.lit("\n"))

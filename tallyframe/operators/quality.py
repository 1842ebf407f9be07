"""Judging pictures: what a cut did, and which frame makes a cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_binary

#: A dip below which a cut shows a transition, the least shift and change of scale that
#: motivate one, and the change of frame below which nothing happened.
DIP, SHIFT, SCALE, INERT = 0.35, 0.20, 0.18, 0.04
#: Fixed values by signal: the raw value below which a frame is bad in itself, and what then remains at zero.
GATES = {"eyes": (0.40, 0.30), "frontal": (0.45, 0.45), "mouth_clear": (0.85, 0.15)}
#: Fixed value: what remains of the score of a frame without a face.
FACELESS = 0.35


def cut_verdict(frame_change: Column, shift: Column, scale: Column, faces: Column, dip: Column) -> Column:
    """What a cut did to the picture: the first of the rules that holds."""
    return F.when(dip < DIP, "transitioned").when(faces == 0, "unreadable").when((shift >= SHIFT) | (scale >= SCALE), "motivated").when(frame_change < INERT, "inert").otherwise("jump_cut")


def clip_verdicts(cuts: DataFrame, by: str) -> DataFrame:
    """(by, cuts, jump_cuts, verdict) from cuts (by, verdict): a clip with any jump cut fails."""
    g = cuts.groupBy(by).agg(F.count("*").alias("cuts"), F.count_if(F.col("verdict") == "jump_cut").alias("jump_cuts"))
    return g.withColumn("verdict", F.when(F.col("jump_cuts") > 0, "fail").otherwise("pass"))


def frontality(right_x: Column, left_x: Column, nose_x: Column) -> Column:
    """1 where the nose is midway between the eyes, 0 where it is as far off as they are apart."""
    span = F.abs(left_x - right_x)
    off = F.abs((nose_x - right_x) - (left_x - nose_x)) / F.nullif(span, F.lit(0.0))
    return F.when(span < 1e-6, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off))


def thirds(x: Column, width: Column) -> Column:
    """1 on a line of thirds, 0 a sixth of the width away from it."""
    at = x / F.nullif(width, F.lit(0.0))
    off = F.least(F.abs(at - 1 / 3), F.abs(at - 2 / 3))
    return F.when(width <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off / (1 / 6)))


def size_score(height: Column, frame: Column) -> Column:
    """A bell over the face's share of the frame's height, highest at about a quarter."""
    off = height / F.nullif(frame, F.lit(0.0)) - 0.26
    return F.when(frame <= 0, 0.0).otherwise(F.exp(-(off * off) / (2 * 0.11**2)))


def gate(values: dict[str, Column], has_face: Column) -> Column:
    """A factor for signals that are bad in themselves: below its gate a signal counts by its square."""
    parts = [F.when(values[k] < least, floor + (1 - floor) * F.pow(values[k] / least, F.lit(2.0))).otherwise(1.0) for k, (least, floor) in GATES.items() if k in values]
    return reduce(lambda a, b: a * b, [*parts, F.when(has_face, 1.0).otherwise(FACELESS)])


def best_cover(frames: DataFrame, by: str, key: str, weights: dict[str, float]) -> DataFrame:
    """(by, key, total) of each group's best frame: signals scaled between the group's least and
    greatest (flat: a half), weighted, times the gate; ties go to the smallest key. The extremes are a
    small aggregate joined back."""
    ends = frames.groupBy(F.col(by).alias("_by")).agg(*(f(k).alias(f"_{n}_{k}") for k in weights for n, f in (("lo", F.min), ("hi", F.max))))
    j = frames.join(ends, F.col(by) == F.col("_by"))

    def scaled(k: str) -> Column:
        lo, span = F.col(f"_lo_{k}"), F.col(f"_hi_{k}") - F.col(f"_lo_{k}")
        return F.when(span <= 1e-9, 0.5).otherwise((F.col(k) - lo) / F.nullif(span, F.lit(0.0)))

    base = reduce(lambda a, b: a + b, (w * scaled(k) for k, w in weights.items()))
    total = F.floor(base * gate({k: F.col(k) for k in weights if k in GATES}, F.col("has_face")) * 1e6 + 0.5) / 1e6
    rated = j.withColumn("total", total)
    return rated.groupBy(by).agg(F.max_by(F.struct(key, "total"), F.struct(F.col("total"), -F.col(key))).alias("r")).select(by, f"r.{key}", "r.total")


def crop_box(face: Column, scale: Column, aspect: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h) of the largest crop of an aspect (9:16, else 16:9) in a frame: with the face (x, y, w,
    h on a frame scaled by `scale`) in its middle and the eyes on the upper third, moved to lie inside the
    frame; without a face or scale in the middle. Halves go to even."""
    target = F.when(aspect == "9:16", F.lit(9 / 16)).otherwise(F.lit(16 / 9))
    tall = target <= width / height
    bounded = lambda c, most: F.greatest(F.lit(2).cast("long"), F.least(c.cast("long"), most.cast("long")))
    h = bounded(F.when(tall, height.cast("double")).otherwise(F.rint(width / target)), height)
    w = bounded(F.when(tall, F.rint(height * target)).otherwise(width.cast("double")), width)
    on_face = face.isNotNull() & (scale > 0)
    by = F.nullif(scale, F.lit(0.0))
    x = F.when(on_face, F.rint((face["x"] + face["w"] / 2) / by - w / 2).cast("long")).otherwise(F.floor((width - w) / 2))
    y = F.when(on_face, F.rint((face["y"] + face["h"] * 0.42) / by - h / 3).cast("long")).otherwise(F.floor((height - h) / 2))
    inside = lambda c, room: F.greatest(F.lit(0).cast("long"), F.least(c, room))
    return F.struct(inside(x, width - w).alias("x"), inside(y, height - h).alias("y"), w.alias("w"), h.alias("h"))


def defocus_pulses(cuts: Column, width: float = 0.24, strength: int = 7) -> Column:
    """A renderer's expression that softens the picture around each cut (array of seconds): a triangle of
    `width` seconds a cut, summed; empty for no cuts."""
    half = repr(round(width / 2, 4))
    one = lambda t: F.concat(F.lit("max(0\\,1-abs(t-"), round_binary(t, 3).cast("string"), F.lit(f")/{half})"))
    return F.when(F.size(cuts) > 0, F.concat(F.lit(f"{strength}*("), F.array_join(F.transform(cuts, one), "+"), F.lit(")"))).otherwise("")

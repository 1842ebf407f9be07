"""Irregular series of one clip: anchors, smoothed paths, simplification, interpolation, nearest values."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import stored
from .folds import folded
from .ranks import upper_medians


def anchors(rows: DataFrame, by: list[str], x: str, spread: float) -> DataFrame:
    """(by, median, anchor): the upper median of the detections, and the mean of those within spread of it.
    Groups of any size; rows without x are left out, and a group without any has no row."""
    some = rows.where(F.col(x).isNotNull()).select(*by, x)
    m = stored(upper_medians(some, by, x).select(*(F.col(c).alias(f"m_{c}") for c in by), "median"))
    on = reduce(lambda a, b: a & b, (some[c].eqNullSafe(m[f"m_{c}"]) for c in by))
    near = some.join(m, on).where(F.abs(F.col(x) - F.col("median")) <= spread)
    return near.groupBy(*by, "median").agg(F.avg(F.col(x).cast("double")).alias("anchor"))


class Follower:
    """A position that follows targets: a share of the way at a time, at most `speed`, jumping at cuts."""

    def __init__(self, deadzone: float, alpha: float, speed: float, top: float) -> None:
        self.deadzone, self.alpha, self.speed, self.top = deadzone, alpha, speed, top
        self.now, self.last = None, None

    def begin(self, start: float, at: float) -> None:
        self.now, self.last = min(max(start, 0.0), self.top), at

    def follow(self, at: float, aim: float | None, jump: bool) -> float:
        """The position after one row: a missing target holds, one within the dead zone is as good as reached."""
        aim = self.now if aim is None or aim != aim else aim
        if jump:
            self.now = aim
        elif abs(aim - self.now) >= self.deadzone:
            most = self.speed * max(1e-3, at - self.last)
            self.now += min(max(self.alpha * (aim - self.now), -most), most)
        self.now, self.last = min(max(self.now, 0.0), self.top), at
        return self.now


def smooth(t: np.ndarray, target: np.ndarray, cut: np.ndarray, start: float, deadzone: float, alpha: float, speed: float, top: float) -> np.ndarray:
    """Positions of a Follower along whole arrays."""
    f = Follower(deadzone, alpha, speed, top)
    f.begin(start, t[0] if len(t) else 0.0)
    return np.array([f.follow(*x) for x in zip(t, target, cut, strict=True)])


def ema_path(rows: DataFrame, by: str, width: float, window: float, deadzone: float = 0.06, alpha: float = 0.12, speed: float = 18.0, top: float | None = None) -> DataFrame:
    """(by, t, x) smoothed positions of the crop's left edge; rows (by, t, x, shot, anchor, ordinal), null x holds.

    Where a shot begins with a detection the position jumps there whatever it was before, so each such
    stretch is folded by itself, in a stream that holds one position."""
    limit = max(0.0, width - window) if top is None else top
    w = Window.partitionBy(by).orderBy("t", "ordinal")
    cut = F.coalesce(F.lag("shot").over(w) != F.col("shot"), F.lit(False))
    aim = F.when(F.col("x").isNotNull(), F.least(F.greatest(F.col("anchor").cast("double") - window / 2, F.lit(0.0)), F.lit(limit)))
    marked = rows.withColumn("_cut", cut).withColumn("_aim", aim)
    marked = marked.withColumn("_run", F.sum(F.when(F.col("_cut") & F.col("_aim").isNotNull(), 1).otherwise(0)).over(w))
    start = F.coalesce(F.col("anchor").cast("double"), F.lit(width / 2)) - window / 2
    series = marked.select(by, "_run", F.col("t").cast("double").alias("t"), "ordinal", F.col("_aim").alias("aim"), "_cut", start.alias("start"))

    def step(f: Follower, row: tuple):
        group, _, t, _, aim, jump, first = row
        if f.now is None:
            f.begin(first, t)
        return ((group, t, round(f.follow(t, aim, bool(jump)), 6)),)

    return folded(series, [by, "_run"], ["t", "ordinal"], lambda: Follower(deadzone * width, alpha, speed, limit), step, lambda _: (), f"{by} {dict(rows.dtypes)[by]}, t double, x double")


def active_speaker(frames: DataFrame, by: str, margin: float = 2.0, keep: float = 0.65) -> DataFrame:
    """(by, frame, active): whose face is followed in each frame of (by, frame, faces array of (cx, area, energy)).

    Faces go by area, the largest first. One face is taken; of the two largest the one whose mouth moves
    at least `margin` times as much as the other's; else the face nearest to the last active place, `keep`
    of the way from there; without one the largest. No face: null, and the last place stays. A frame with
    one face or a clear winner does not depend on those before it, so a clip is folded from such frame to
    such frame, in streams that hold one place. A null energy or area is none, a face without a place is
    none; null or no faces are alike; repeated frames go by their faces.
    """
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    faces = F.filter("faces", lambda x: x.isNotNull() & x["cx"].isNotNull())
    order = F.transform(faces, lambda x, i: F.struct((-zero(x["area"])).alias("a"), i.alias("i"), x["cx"].cast("double").alias("cx"), zero(x["energy"]).alias("e")))
    f = frames.select(by, "frame", F.coalesce(F.array_sort(order), F.array().cast("array<struct<a:double,i:int,cx:double,e:double>>")).alias("f"))
    one, two = F.get("f", F.lit(0)), F.get("f", F.lit(1))
    best, next_ = F.greatest(one["e"], two["e"]), F.least(one["e"], two["e"])
    sure = F.when(F.size("f") == 1, one["cx"]).when((F.size("f") > 1) & (best > 0) & (best >= margin * F.greatest(next_, F.lit(1e-6))), F.when(one["e"] == best, one["cx"]).otherwise(two["cx"]))
    f = f.select(by, "frame", F.transform("f", lambda x: x["cx"]).alias("cx"), sure.alias("sure"))
    w = Window.partitionBy(by).orderBy("frame")
    f = f.withColumn("run", F.count("sure").over(w.rangeBetween(Window.unboundedPreceding, 0)))

    def step(state: dict, row: tuple):
        group, _, frame, cx, sure = row
        last, now = state.get("last"), None
        if len(cx):
            if sure is not None and sure == sure:
                now = sure
            elif last is None:
                now = cx[0]
            else:
                now = keep * min(cx, key=lambda x: abs(x - last)) + (1 - keep) * last
            state["last"] = now
        return ((group, frame, None if now is None else float(now)),)

    types = dict(frames.dtypes)
    return folded(f.select(by, "run", "frame", "cx", "sure"), [by, "run"], ["frame", F.col("sure").isNull(), "cx"], dict, step, lambda _: (), f"{by} {types[by]}, frame {types['frame']}, active double")


def simplified(t: np.ndarray, x: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept by splitting at the largest vertical deviation while it exceeds the tolerance."""
    n = len(t)
    keep = np.zeros(n, bool)
    keep[[0, n - 1] if n else []] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner = slice(a + 1, b)
        line = x[a] + (x[b] - x[a]) * (t[inner] - t[a]) / (t[b] - t[a]) if t[b] > t[a] else x[a]
        off = np.abs(x[inner] - line)
        if off.max() > tolerance:
            m = a + 1 + int(off.argmax())
            keep[m] = True
            todo += [(a, m), (m, b)]
    return keep.nonzero()[0]


def rdp_path(rows: DataFrame, by: str, tolerance: float) -> DataFrame:
    """(by, t, x): the breakpoints of each group's polyline."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "x"], ignore_index=True)
        return pdf.loc[simplified(pdf.t.to_numpy(float), pdf.x.to_numpy(float), tolerance), [by, "t", "x"]]

    types = dict(rows.dtypes)
    return rows.select(by, "t", "x").where("x is not null").groupBy(by).applyInPandas(group, f"{by} {types[by]}, t double, x double")


def interpolate(curve: Column, at: Column, clamp_low: bool = True) -> Column:
    """y at a position of a curve of (x, y) sorted by x. Past the end, and before the start unless
    clamp_low, it is the last y; before the start with clamp_low the first."""
    pairs = F.zip_with(F.slice(curve, 1, F.size(curve) - 1), F.slice(curve, 2, F.size(curve) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    span = lambda p: p["b"]["x"] - p["a"]["x"]
    inside = lambda p: F.when(span(p) == 0, p["a"]["y"]).otherwise(p["a"]["y"] + (at - p["a"]["x"]) / F.nullif(span(p), F.lit(0.0)) * (p["b"]["y"] - p["a"]["y"]))
    # the pairs are searched once, however often the one found is used
    hit = F.get(F.transform(F.filter(pairs, lambda p: (p["a"]["x"] <= at) & (at <= p["b"]["x"])), lambda p: F.struct(inside(p).alias("y"))), F.lit(0))
    last, first = F.get(curve, F.size(curve) - 1)["y"], F.get(curve, F.lit(0))
    out = F.coalesce(hit, F.struct(last.alias("y")))["y"]
    return F.when(F.lit(clamp_low) & (at <= first["x"]), first["y"]).otherwise(out)


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, value: str, slice_s: float = 3600.0) -> DataFrame:
    """left with the value of right nearest in time, by group; ties take the earlier time, and of equal
    times the largest value.

    Time is cut into slices: within one, a window carries the last and the next value; from slice to
    slice go only each slice's first and last value. So a long group is spread over its slices.
    Repeated rows each get a row; a null group or time, and a group without values, find nothing.
    """
    point = lambda t, x: F.struct(t.cast("double").alias("at"), x.alias("v"))
    r = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(at).alias("_at")).agg(F.max(value).alias("_v"))
    r = r.select("_by", "_at", point(F.col("_at"), F.col("_v")).alias("_p"))
    asked = left.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_by"), F.col(at).alias("_at")).distinct().withColumn("_p", F.lit(None).cast(r.schema["_p"].dataType))
    rows = r.union(asked).withColumn("_slice", F.floor(F.col("_at") / slice_s))
    w = Window.partitionBy("_by", "_slice").orderBy("_at")
    ahead, behind = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    near = rows.withColumn("_last", F.last("_p", ignorenulls=True).over(ahead)).withColumn("_next", F.first("_p", ignorenulls=True).over(behind)).where("_p is null")
    ends = rows.groupBy(F.col("_by").alias("s_by"), F.col("_slice").alias("s_slice")).agg(F.max("_p").alias("top"), F.min("_p").alias("low"))
    s = Window.partitionBy("s_by").orderBy("s_slice")
    carried = ends.select("s_by", "s_slice", F.last("top", ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("low", ignorenulls=True).over(s.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    j = near.join(carried, (F.col("_by") == F.col("s_by")) & (F.col("_slice") == F.col("s_slice")), "left")
    last, after = F.coalesce("_last", "before"), F.coalesce("_next", "after")
    pick = F.when(after.isNull() | (F.col("_at") - last["at"] <= after["at"] - F.col("_at")), last["v"]).otherwise(after["v"])
    found = j.select("_by", "_at", pick.alias(value))
    return left.join(found, (F.col(by) == F.col("_by")) & (F.col(at) == F.col("_at")), "left").select(*(left[c] for c in left.columns), found[value])


def expression(rows: DataFrame, by: str, name: str = "t") -> DataFrame:
    """(by, expr): the polyline (t, x) as nested conditions on the time, for a renderer: the segment
    that holds the time, interpolated; the ends hold outside."""
    pts = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x")))).alias("p"))
    last = F.format_string("%.3f", F.get("p", F.size("p") - 1)["x"])
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def part(s: Column) -> Column:
        a, b = s["a"], s["b"]
        slope = F.when(b["t"] > a["t"], (b["x"] - a["x"]) / F.nullif(b["t"] - a["t"], F.lit(0.0))).otherwise(0.0)
        return F.format_string(f"if(lt({name},%.3f),%.3f+(%.5f)*({name}-%.3f),", b["t"], a["x"], slope, a["t"])

    first = F.col("p")[0]
    head = F.format_string(f"if(lt({name},%.3f),%.3f,", first["t"], first["x"])
    text = F.concat(head, F.array_join(F.transform(pairs, part), ""), last, F.repeat(F.lit(")"), F.size("p")))
    return pts.select(by, text.alias("expr"))

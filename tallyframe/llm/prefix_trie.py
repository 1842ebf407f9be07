"""The trie of conversation prefixes, with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns. It is named by 128 bits: two sums, over the sequence's
turns, of hashes of place and content (a 128-bit digest of role and text), each of two 32-bit halves
that wrap around. n different sequences are confused with probability n**2 / 2**129.

Each node's heavy child is the one with most members, so a light child has at most half of its
parent's, and no node lies below more than log2(conversations) light edges. A heavy path ends in a
leaf, and the smallest conversation through that leaf is the path's name: the path's nodes are that
conversation's turns from its last light edge on. Totals of paths are attached to the parents of
their heads, level by level from the deepest, in at most that many rounds; then one suffix sum along
the paths gives every node's subtree. Nothing depends on a conversation fitting into one task: places
and sums within a conversation or a path are taken in stretches, and the stretches' totals are added.

Defined cases: a null role or text is empty; null turns come first, equal turns go by role and then by
the text's digest, and repeated rows are turns of their own; rows with a null conversation are left
out; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, stored

#: Turns of a conversation or path, and ids of a list of ends, in a stretch.
STRETCH = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
_MASK = (1 << 32) - 1


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, content, n_bytes, n): each turn's place from 1 in its conversation of n turns.

    Rows are sorted by ranges over all tasks, so a long conversation lies in several; each stretch's
    first place is the sum of the stretches before it.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    content = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), content.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", "turn", "role", "content"]
    ranked = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "content", "n_bytes", F.monotonically_increasing_id().alias("at")))
    ranked = ranked.withColumn("part", F.shiftright("at", 33))
    w = Window.partitionBy("conv_id")
    parts = ranked.groupBy("conv_id", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    parts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("here").over(w).alias("n"))
    return ranked.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "content", "n_bytes", "n")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation c begins with the first h turns of c - c % every and goes
    on with its own after its first h; h is crc32(decimal c) % most. conversations: (conv_id, n)."""
    turns = stored(turns)
    c = turns.groupBy("conv_id").agg(F.max("n").alias("n"))
    c = c.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    base = c.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    c = c.join(base, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))))
    c = stored(c.select("conv_id", "base", "h", "lead", (F.col("lead") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n")))
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "content", "n_bytes").join(c.select("conv_id", "base", "h"), "base").where("pos <= h")
    later = turns.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    own = later.drop("n").join(c.select("conv_id", "h", "lead"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "content", "n_bytes")
    return heads.select("conv_id", "pos", "content", "n_bytes").unionByName(own), c.select("conv_id", "n")


def running(rows: DataFrame, by: str, place: str, sums: list[str], down: bool = False) -> DataFrame:
    """rows with each of `sums` replaced by its sum up to the place within `by` (from it on, with down).

    Within a stretch a window adds up; stretches' totals are added for those that have several.
    """
    rows = rows.withColumn("_s", F.floor(F.col(place) / STRETCH))
    totals = rows.groupBy(by, "_s").agg(*(F.sum(c).alias(f"t_{c}") for c in sums))
    order = F.desc if down else F.asc
    w = Window.partitionBy(by).orderBy(order("_s"))
    before = totals.select(F.col(by).alias("b_by"), F.col("_s").alias("b_s"), *(F.sum(f"t_{c}").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"b_{c}") for c in sums)).where(F.col(f"b_{sums[0]}").isNotNull())
    own = Window.partitionBy(by, "_s").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(own) for c in sums})
    j = local.join(before, (F.col(by) == F.col("b_by")) & (F.col("_s") == F.col("b_s")), "left")
    return j.withColumns({c: F.col(c) + F.coalesce(F.col(f"b_{c}"), F.lit(0)) for c in sums}).select(*(c for c in rows.columns if c != "_s"))


def _name(a: Column, b: Column) -> Column:
    """Two sums' low halves in one number."""
    return F.shiftleft(a.bitwiseAND(_MASK), 32).bitwiseOR(b.bitwiseAND(_MASK))


def named(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_bytes, last): each conversation's nodes from the root on, with
    the parent's name; last where the conversation ends."""
    parts = {}
    for i in (1, 2):
        x = F.xxhash64(F.lit(i), "content", "pos")
        parts |= {f"o{i}a": F.shiftrightunsigned(x, 32), f"o{i}b": x.bitwiseAND(_MASK)}
    own = turns.select("conv_id", "pos", "n_bytes", *(v.alias(k) for k, v in parts.items()), *(v.alias(k.replace("o", "s")) for k, v in parts.items()))
    r = running(own, "conv_id", "pos", [k.replace("o", "s") for k in parts])
    key = [_name(F.col(f"s{i}a"), F.col(f"s{i}b")).alias(f"k{i}") for i in (1, 2)]
    up = [_name(F.col(f"s{i}a") - F.col(f"o{i}a"), F.col(f"s{i}b") - F.col(f"o{i}b")).alias(f"p{i}") for i in (1, 2)]
    zero = lambda *names: [F.lit(0).cast("long").alias(x) for x in names]
    nodes = r.select("conv_id", F.col("pos").alias("depth"), *key, *up, "n_bytes")
    root = convs.select("conv_id", *zero("depth", "k1", "k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), *zero("n_bytes"))
    ends = convs.select(F.col("conv_id").alias("e_conv"), F.col("n").alias("e_n"))
    marked = nodes.unionByName(root).join(ends, (F.col("conv_id") == F.col("e_conv")) & (F.col("depth") == F.col("e_n")), "left")
    return marked.select(*nodes.columns, F.col("e_n").isNotNull().alias("last"))


def ends_digest(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of rows (conv_id, k1, k2): SHA-256 of a node's ids, ascending, comma-joined.

    Ids are joined by ranges of STRETCH numbers; a task then digests a node's ranges as they stream by.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    ranges = rows.groupBy("k1", "k2", F.floor(F.col("conv_id") / STRETCH).alias("range")).agg(ids.alias("ids"))

    def run(batches):
        now, digest, done = None, None, []
        for b in batches:
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([{"k1": a, "k2": c, "ends_sha256": d} for a, c, d in done], schema)
            done = []
        if now:
            yield pa.RecordBatch.from_pylist([{"k1": now[0], "k2": now[1], "ends_sha256": digest.hexdigest()}], schema)

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    return ranges.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "range").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. turns: (conv_id, pos from 1 without gaps, content, n_bytes); convs:
    (conv_id, n turns), those without turns included."""
    rows, me = stored(named(turns, convs)), ["k1", "k2"]
    nodes = rows.groupBy(*me, "p1", "p2").agg(F.min("conv_id").alias("node"), F.min("depth").alias("n_depth"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("bytes"))
    nodes = stored(nodes)
    family = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), (-F.max(F.struct("n_convs", (-F.col("node")).alias("node")))["node"]).alias("heavy"))
    nodes = stored(nodes.join(family.where("k1 is not null"), me, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parent = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("heavy").alias("chosen"), F.col("n_children").alias("siblings"))
    told = join_by_key(nodes, parent, ["p1", "p2"], "siblings")
    light = F.col("parent").isNotNull() & (F.col("chosen") != F.col("node"))
    told = stored(told.select(*me, "node", "parent", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"), light.alias("light")))

    # paths: from a leaf's smallest conversation's last light edge on
    seen = stored(join_by_key(rows.drop("n_bytes"), told, me, "n_convs"))
    leaf = F.col("last") & (F.col("n_children") == 0) & (F.col("node") == F.col("conv_id"))
    paths = seen.groupBy("conv_id").agg(F.max(F.when(F.col("light"), F.col("depth")).otherwise(0)).alias("top"), F.count_if("light").alias("level"), F.max(leaf).alias("is_path"), F.count("*").alias("turns"))
    paths = stored(paths.where("is_path").select("conv_id", "top", "level", "turns"))
    own = stored(join_by_key(seen, paths, ["conv_id"], "turns").where("depth >= top").select(F.col("conv_id").alias("path"), "level", "top", "depth", *me, "p1", "p2", "node", "parent", "n_convs", "n_children", "value"))

    # each path hangs on a node of another path; totals go up level by level
    above = own.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("path").alias("onto"), F.col("n_children").alias("n_here"))
    heads = join_by_key(own.where("depth = top and depth > 0").select("path", "level", "depth", "p1", "p2"), stored(above), ["p1", "p2"], "n_here")
    total = own.groupBy("path").agg(F.sum("value").alias("saved"))
    heads = stored(heads.join(total, "path").select("path", "level", "onto", (F.col("depth") - 1).alias("at"), "saved", F.lit(1).cast("long").alias("leaves")))
    deepest, levels, more = heads.agg(F.max("level")).first()[0] or 0, [], None
    for level in range(deepest, 0, -1):
        now = heads.where(F.col("level") == level)
        if more is not None:
            now = now.join(more, "path", "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"m_{c}"), F.lit(0)) for c in ("saved", "leaves")})
        now = stored(now.select("onto", "at", "saved", "leaves"))
        more = now.groupBy(F.col("onto").alias("path")).agg(F.sum("saved").alias("m_saved"), F.sum("leaves").alias("m_leaves"))
        levels.append(now)
    nothing = heads.select("onto", "at", "saved", "leaves").limit(0)
    for now in levels:
        nothing = nothing.unionByName(now)
    hung = nothing.groupBy(F.col("onto").alias("path"), F.col("at").alias("depth")).agg(F.sum("saved").alias("h_saved"), F.sum("leaves").alias("h_leaves"))
    full = own.join(hung, ["path", "depth"], "left").withColumn("saved", F.col("value") + F.coalesce("h_saved", F.lit(0))).withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0) + F.coalesce("h_leaves", F.lit(0)))
    summed = running(full.select("path", "depth", *me, "node", "parent", "n_convs", "n_children", "saved", "leaves"), "path", "depth", ["saved", "leaves"], down=True)
    out = summed.join(ends_digest(rows.where("last").select("conv_id", *me)), me, "left")
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

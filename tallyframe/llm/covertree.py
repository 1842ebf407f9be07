"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label form a class. The top level of a label's tree is a bounded set of sampled
centres; each class goes to its nearest centre's cell, whose covering radius is the largest such
distance. Cells that hold too many classes get centres of their own, level by level. A class outside a cell is no neighbour of anything in it if its distance to the centre
exceeds the radius plus the link distance. Two cells whose centres' distance plus both radii stays
below it link as a whole, settled by bound for the members of both; otherwise the classes of one of the two
that may have neighbours in the other visit it, and a link found there counts for both its ends. A cell's own
classes are held, with a tree of halving radii; its visitors stream past by some thousands, each lot with a tree
of its own, and two trees are walked in pairs with the same two bounds on node pairs. A node that halving
does not compress is a leaf however large. Leaves meet in blocks: cosines in single precision, and in double
precision where the rounding could decide.

Pairs are counted and merged into a spanning set of links where they are found, never emitted. Without structure
all pairs of a label have to be compared, so the comparisons and the visits, about half a cell's
share of the label each, grow with the square of its classes.

Defined cases: a null label, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing; vectors of unequal lengths do not link; a null vec_id links with
nothing, has a null component and is kept; repeated rows, and rows with one vec_id, are vectors of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_by_key, stored

COSINE = 0.93
#: Classes a cell should have; centres in all, and bytes of them; own classes in a block of a cell; points in a leaf that halving can compress.
CELL, CENTRES, CENTRE_BYTES, BLOCK, LEAF = 8192, 4096, 1 << 25, 16384, 256
#: Visitors that meet a block at a time; rows of an Arrow batch; cosines held at a time; points that a node's parts have on average.
VISITORS, ROWS, HELD, COMPRESSED = 8192, 8192, 1 << 21, 8
EDGE = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chord distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Node:
    """Points of a ball: indices, centre, covering radius, and children of half the radius or none."""

    def __init__(self, x: np.ndarray, idx: np.ndarray):
        self.idx, self.children = idx, []
        own = x[idx]
        self.centre = own[0]
        d = _distance(self.centre[None], own)[0]
        self.radius = float(d.max())
        if len(idx) <= LEAF or self.radius <= EDGE:
            return
        left, parts = np.arange(len(idx)), []
        while len(left):  # the next point left is a centre of the level below and covers what it can
            if len(parts) >= 2 * COMPRESSED and len(idx) - len(left) < COMPRESSED * len(parts):
                return  # halving does not compress: stay a leaf
            near = _distance(own[left[:1]], own[left])[0] <= self.radius / 2
            near[0] = True
            parts.append(idx[left[near]])
            left = left[~near]
        self.children = [Node(x, p) for p in parts] if len(parts) > 1 else []


class Points:
    """Classes with their tree: vectors and lengths, unit vectors in single precision, weights, and the links counted so far."""

    def __init__(self, rep: np.ndarray, weights: np.ndarray, x: np.ndarray):
        self.rep, self.weights, self.x = rep, weights.astype(float), x
        self.norm = np.linalg.norm(x, axis=1)
        unit = x / self.norm[:, None]
        self.single, self.count, self.tree = unit.astype(np.float32), np.zeros(len(x)), Node(unit, np.arange(len(x)))


def _merge(label: np.ndarray, idx: np.ndarray) -> None:
    old = np.unique(label[idx])
    if len(old) > 1:
        to = np.arange(len(label))
        to[old] = old[0]
        label[:] = to[label]


def _linked(own: Points, rows: np.ndarray, other: Points, columns: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two leaves with that cosine at least, row by row. Single precision tells it up to its
    rounding, for which the slack is twice the bound; between, it is worked out in double precision."""
    slack = np.float32((own.x.shape[1] + 16) * 2.0**-23)
    dots = own.single[rows] @ other.single[columns].T
    i, j = (dots >= np.float32(cosine) - slack).nonzero()
    close = (dots[i, j] < np.float32(cosine) + slack).nonzero()[0]
    keep = np.ones(len(i), bool)
    for k in range(0, len(close), 1 << 14):
        at = close[k : k + (1 << 14)]
        a, b = rows[i[at]], columns[j[at]]
        keep[at] = np.einsum("ij,ij->i", own.x[a], other.x[b]) / (own.norm[a] * other.norm[b]) >= cosine
    return rows[i[keep]], columns[j[keep]]


def traverse(own: Points, other: Points, label: np.ndarray, cosine: float) -> None:
    """Adds the links between two sets, or of a set within itself, to their counts and to label, a partition
    of the own and then the other points."""
    reach, within = float(np.sqrt(2 - 2 * cosine)), other is own
    first = 0 if within else len(own.x)
    pairs = [(own.tree, other.tree)]
    while pairs:
        a, b = pairs.pop()
        d = float(_distance(a.centre[None], b.centre[None])[0, 0])
        if d - a.radius - b.radius > reach + EDGE:
            continue
        if d + a.radius + b.radius < reach - EDGE:
            own.count[a.idx] += other.weights[b.idx].sum()
            if not within:
                other.count[b.idx] += own.weights[a.idx].sum()
            _merge(label, np.concatenate([a.idx, b.idx + first]))
        elif a.children and (a.radius >= b.radius or not b.children):
            pairs += [(c, b) for c in a.children]
        elif b.children:
            pairs += [(a, c) for c in b.children]
        else:
            for y in range(0, len(b.idx), VISITORS):
                columns = b.idx[y : y + VISITORS]
                step = max(1, HELD // len(columns))
                for z in range(0, len(a.idx), step):
                    i, j = _linked(own, a.idx[z : z + step], other, columns, cosine)
                    own.count += np.bincount(i, other.weights[j], len(own.count))
                    if not within:
                        other.count += np.bincount(j, own.weights[i], len(other.count))
                    apart = label[i] != label[j + first]
                    starts = np.flatnonzero(np.diff(i, prepend=-1))
                    for k in np.unique(np.searchsorted(starts, apart.nonzero()[0], "right") - 1):
                        found = j[starts[k] : starts[k + 1] if k + 1 < len(starts) else None] + first
                        if (label[found] != label[i[starts[k]]]).any():
                            _merge(label, np.append(found, i[starts[k]]))


def _vectors(column) -> np.ndarray:
    """A list column as a matrix; its lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _groups(column) -> Iterator[tuple[str, np.ndarray]]:
    """A column's values, and the rows that have them."""
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    yield from zip(coded.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))[:-1]), strict=True)


_CLASS = ("grp", "own", "rep", "mult", "bulk", "sure", "v")


def _class(rows: DataFrame) -> str:
    """The schema of classes; vectors are carried in single precision if they are given so."""
    return f"grp string, own boolean, rep long, mult long, bulk double, sure array<long>, v {dict(rows.dtypes)['v']}"


def _visits(home, cell):
    """Whether the classes of a cell visit another, or its classes them: of two cells, numbers or columns, one visits."""
    return ((home + cell) % 2 == 0) == (home < cell)


def _place(sent):
    """Each class's nearest centre and its distance to it; a group without centres is one cell."""

    def run(batches):
        for t in batches:
            cell, dist = np.full(t.num_rows, -1, np.int64), np.zeros(t.num_rows)
            for g, at in _groups(t.column("grp")):
                if g in sent.value:
                    first, centres = sent.value[g]
                    d = _distance(_unit(_vectors(t.column("v").take(pa.array(at)))), centres)
                    cell[at], dist[at] = first + d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in _CLASS), pa.array(cell), pa.array(dist)], names=[*_CLASS, "cell", "dist"])

    return run


def _visit(sent, ids, cells, reach):
    """Rows for each cell that a class is in (own) or visits; links settled by the bounds alone. What
    visits the group already (not own) only visits its cells."""

    def run(batches):
        for t in batches:
            home, mine = t.column("cell").to_numpy(), t.column("own").to_numpy(zero_copy_only=False)
            bulk, other = t.column("bulk").to_numpy().copy(), {}
            at, cell, own = [mine.nonzero()[0]], [home[mine]], [np.ones(mine.sum(), bool)]
            for g, i in _groups(t.column("grp")):
                if g not in sent.value:
                    i = i[~mine[i]]
                    at, cell, own = [*at, i], [*cell, home[i]], [*own, np.zeros(len(i), bool)]
                    continue
                first, centres = sent.value[g]
                d = _distance(_unit(_vectors(t.column("v").take(pa.array(i)))), centres)
                radius, weight = cells.value[0][first : first + len(centres)], cells.value[1][first : first + len(centres)]
                away = (np.arange(len(centres)) + first != home[i][:, None]) | ~mine[i][:, None]
                homes, own_home = np.unique(home[i] - first, return_inverse=True)
                whole = _distance(centres[homes], centres) + radius[homes, None] + radius < reach - EDGE  # the same from both cells
                inside = away & whole[own_home] & (weight > 0) & mine[i][:, None]
                bulk[i] += inside @ weight
                for a, j in zip(*inside.nonzero(), strict=True):
                    other.setdefault(i[a], []).append(int(ids.value[first + j]))
                goes = _visits(home[i][:, None], np.arange(len(centres)) + first) | ~mine[i][:, None]
                a, j = (away & ~inside & goes & (d <= radius + reach + EDGE) & (weight > 0)).nonzero()
                at, cell, own = [*at, i[a]], [*cell, first + j], [*own, np.zeros(len(a), bool)]
            at, cell, own = np.concatenate(at), np.concatenate(cell), np.concatenate(own)
            had = t.column("sure")
            for k in range(0, len(at), ROWS):
                a, o = at[k : k + ROWS], own[k : k + ROWS]
                take = pa.array(a)
                sure = [(had[i].as_py() or []) + other.get(i, []) if x else [] for i, x in zip(a.tolist(), o.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [t.column("grp").take(take), pa.array(o), t.column("rep").take(take), t.column("mult").take(take), pa.array(np.where(o, bulk[a], 0.0)), pa.array(sure, pa.list_(pa.int64())), t.column("v").take(take), pa.array(cell[k : k + ROWS])],
                    names=[*_CLASS, "cell"],
                )

    return run


def _level(rows: DataFrame, large: list, cosine: float, cell: int) -> DataFrame:
    """The rows with a cell, and again for each cell that they visit. large: (grp, n, size) of the groups
    that get centres, about n / cell each and CENTRES in all; a group without centres is one cell."""
    spark = rows.sparkSession
    send = spark.sparkContext.broadcast
    room = min(CENTRES, CENTRE_BYTES // (8 * max((r["size"] for r in large), default=1)))
    scale = min(1.0, room * cell / max(1, sum(r.n for r in large)))
    wanted = {r.grp: max(1, int(scale * r.n / cell)) for r in large}
    tops, ids, first = {}, [], 0
    if wanted:  # the classes of smallest hash, a few more than are wanted of each group: bounded by the room
        share = F.create_map(*(F.lit(x) for r in large for x in (r.grp, min(1.0, (2 * wanted[r.grp] + 8) / r.n))))
        draw = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 40))
        sample = rows.where(F.col("own") & F.col("grp").isin(*wanted)).withColumn("draw", draw).where(F.col("draw") < share[F.col("grp")] * (1 << 40)).select("grp", "rep", "v", "draw").collect()
        by: dict[str, list] = {}
        for r in sorted(sample, key=lambda r: (r.grp, r.draw, r.rep)):
            by.setdefault(r.grp, []).append(r)
        for g, found in by.items():
            chosen = found[: wanted[g]]
            tops[g] = (first, _unit(np.array([r.v for r in chosen], float)))
            ids += [r.rep for r in chosen]
            first += len(chosen)
    sent, reach = send(tops), float(np.sqrt(2 - 2 * cosine))
    placed = stored(rows.select(*_CLASS).mapInArrow(_place(sent), _class(rows) + ", cell long, dist double"))
    radius, weight = np.zeros(first), np.zeros(first)
    for r in placed.where("own and cell >= 0").groupBy("cell").agg(F.max("dist").alias("radius"), F.sum("mult").alias("weight")).collect():
        radius[r.cell], weight[r.cell] = r.radius, r.weight
    return stored(placed.mapInArrow(_visit(sent, send(np.array(ids, np.int64)), send((radius, weight)), reach), _class(rows) + ", cell long"))


def _cells(classes: DataFrame, cosine: float, cell: int) -> DataFrame:
    """The classes in cells, with those that visit them. A cell of more than BLOCK classes gets centres of
    its own in a level below, as many cells at a time as CENTRES allows; one that its centres don't
    take apart (a part keeps nine tenths) stays as it is."""
    n = [F.count("*").alias("n"), F.first(F.size("v")).alias("size")]
    large = classes.groupBy("grp").agg(*n).where(F.col("n") > cell).orderBy(F.desc("n"), "grp").limit(CENTRES).collect()
    visits, kept = _level(classes, large, cosine, cell), {r.grp: r.n for r in large}
    while True:
        sizes = visits.where("own").groupBy("grp", "cell").agg(*n).where(F.col("n") > BLOCK)
        big = [r for r in sizes.orderBy(F.desc("n"), "grp", "cell").limit(CENTRES).collect() if r.n <= 0.9 * kept.get(r.grp, float("inf"))]
        some, room = [], CENTRES
        for r in big:  # the largest first, while their centres fit
            room -= -(-r.n // cell)
            if room < 0 and some:
                break
            some.append(r)
        if not some:
            return visits
        below = [type("Large", (dict,), {"__getattr__": dict.__getitem__})(grp=f"{r.grp}|{r.cell}", n=r.n, size=r["size"]) for r in some]
        kept |= {r.grp: r.n for r in below}
        name = F.concat_ws("|", "grp", F.col("cell").cast("string"))
        mine = name.isin([r.grp for r in below])
        lower = visits.where(mine).withColumn("grp", name).drop("cell")
        visits = stored(visits.where(~mine).unionByName(_level(lower, below, cosine, cell)))


def _link(cosine):
    """Rows in order of (grp, cell, block), own classes first: for each class its weight of linked vectors and
    links that join its component. A block's own classes are held, its visitors pass by VISITORS at a time."""

    def answer(rep, linked, near):
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.asarray(linked, np.int64)), pa.array(near, pa.list_(pa.int64()))], names=["rep", "linked", "near"])

    def points(rows):
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        return t, Points(t.column("rep").to_numpy(), t.column("mult").to_numpy(), _vectors(t.column("v")))

    def near(label, reps, first):
        return [[int(reps[x])] if x != k else [] for k, x in enumerate(label[first:].tolist(), first)]

    def visited(held, label, lot):
        """What visitors have found; the held classes keep their counts and their partition."""
        _, met = points(lot)
        both = np.append(label, np.arange(len(label), len(label) + len(met.x)))
        traverse(held, met, both, cosine)
        label[:] = both[: len(label)]
        some = (met.count > 0).nonzero()[0]
        links = near(both, np.append(held.rep, met.rep), len(label))
        return answer(met.rep[some], met.count[some], [links[k] for k in some])

    def ended(t, held, label):
        return answer(held.rep, held.count + t.column("bulk").to_numpy(), [a + (b or []) for a, b in zip(near(label, held.rep, 0), t.column("sure").to_pylist(), strict=True)])

    def stretches(batches):
        """(key, whether own, rows): the stretches of the batches with one key."""
        for t in batches:
            keys = list(zip(*(t.column(c).to_pylist() for c in ("grp", "cell", "block", "own")), strict=True))
            ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
            for a, b in zip([0, *ends], ends, strict=False):
                if b > a:
                    yield keys[a][:3], keys[a][3], t.slice(a, b - a)

    def run(batches):
        at, own = None, None
        for (key, mine), rows in groupby(stretches(batches), lambda x: x[:2]):
            if key != at:
                if own:
                    yield ended(*own)
                at, own = key, None
            if mine:
                t, held = points([x[2] for x in rows])
                own = t, held, np.arange(len(held.x))
                traverse(held, held, own[2], cosine)
            elif own:
                lot, n = [], 0
                for *_, some in rows:
                    lot, n = [*lot, some], n + some.num_rows
                    if n >= VISITORS:
                        yield visited(*own[1:], lot)
                        lot, n = [], 0
                if lot:
                    yield visited(*own[1:], lot)
        if own:
            yield ended(*own)

    return run


def covertree_dedup(table: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per input row."""
    spark = table.sparkSession
    v = F.col("embedding") if dict(table.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size("v") == 0) | ~F.exists("v", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad, F.lit(False))
    rows = stored(rows.withColumn("grp", F.when(usable, F.concat_ws("|", F.size("v").cast("string"), F.col("label").cast("string")))))
    good = rows.where("grp is not null")
    classes = good.groupBy("grp", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))  # a class's own id: a vec_id may be in several
    own = classes.select("grp", F.lit(True).alias("own"), "rep", "mult", F.lit(0.0).alias("bulk"), F.array().cast("array<long>").alias("sure"), "v")
    visits = _cells(own, cosine, cell)
    sizes = visits.where("own").groupBy(F.col("grp").alias("b_grp"), F.col("cell").alias("b_cell")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = visits.join(F.broadcast(sizes.where("blocks > 1")), (F.col("grp") == F.col("b_grp")) & (F.col("cell") == F.col("b_cell")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.where(~F.col("own") | (F.col("mine") == F.col("block")) | _visits(F.col("mine"), F.col("block"))).withColumn("own", F.col("own") & (F.col("mine") == F.col("block")))
    dealt = dealt.select("grp", "cell", "block", "own", "rep", "mult", F.when(F.col("own"), F.col("bulk")).otherwise(0.0).alias("bulk"), F.when(F.col("own"), F.col("sure")).alias("sure"), "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "grp", "cell", "block").sortWithinPartitions("grp", "cell", "block", F.desc("own"))
    found = stored(dealt.mapInArrow(_link(cosine), "rep long, linked long, near array<long>"))
    labels = components(found.select(F.col("rep").alias("a"), F.explode("near").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    told = stored(classes.join(linked, "rep").join(labels, F.col("rep") == F.col("id"), "left").select("grp", "v", "mult", "least", "linked", F.coalesce("component_id", "rep").alias("root")))
    smallest = stored(told.groupBy("root").agg(F.min("least").alias("smallest"), F.count("*").alias("classes")))
    told = stored(join_by_key(told, smallest, ["root"], "classes").select("grp", "v", "mult", "linked", "smallest"))
    out = join_by_key(rows, told, ["grp", "v"], "mult")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("linked") - 1, F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

"""Hard-negative mining with a vector-approximation file.

Each dimension is cut into CELLS cells of equal width between its smallest and largest value, and a
vector's approximation is its cell in each. For an anchor a table of every cell's least contribution
to the inner product is made per dimension; a row's lower bound is the sum of what its cells look up,
its upper bound that plus the cells' spread, the same for all rows. Only rows whose bounds let them
enter an anchor's best positives, or one of its windows of negatives, are scored exactly.

The anchors are a stated query set against all rows, in blocks: rows are dealt into groups of about
ROWS and anchors of about ANCHORS by their hashes, and a task compares one group of each, whatever the
labels, so no hot label meets in a task. A group's best are few, and their merge is a window by anchor.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no
part; rows that repeat id, label and vector count once, and rows that share only the id are rows of
their own, but never each other's positive or negative; vectors meet only those of their length, and
inner products of no component are 0; ties go to the smaller id; components whose products do not
fit into 62 bits raise; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Cells of a dimension; rows and anchors of a group, on average.
CELLS, ROWS, ANCHORS = 64, 8192, 512
_FILE = "rid long, vec_id long, label int, dims int, anchor boolean, g int, a int, cells binary, exact binary"


def mined(rows: DataFrame, scale: int = 256, every: int = 50) -> DataFrame:
    """(vec_id, label, vec, anchor) of the contract: every 7th row takes the next label, components are
    floor(scale * x), anchors are the rows whose id is divisible by `every`."""
    x = F.col("embedding").cast("array<double>")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform(x, lambda v: F.floor(v * scale))
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), vec.alias("vec"), (F.col("vec_id") % every == 0).alias("anchor"))


def approximated(rows: DataFrame, ids: list[str], n_cells: int = CELLS, sizes: tuple[int, int] = (ROWS, ANCHORS)) -> tuple[DataFrame, dict[int, tuple], int, int]:
    """(file, grid, row groups, anchor groups): one row a vector, with its cells and its exact components.

    grid: for each length of vector its dimensions' least values and cell widths: as many numbers as
    the vectors have dimensions, gathered by grouped extremes."""
    rows = stored(rows.dropDuplicates([*ids, "vec"]))
    ends = rows.select(F.size("vec").alias("dims"), F.posexplode_outer("vec").alias("d", "v")).groupBy("dims", "d").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("dims", "d").collect()
    grid = {}
    for dims in {r.dims for r in ends}:
        low, high = ([r[c] for r in ends if r.dims == dims and r.d is not None] for c in ("low", "high"))
        if dims and dims * max(map(abs, low + high)) ** 2 >= 1 << 62:
            raise ValueError(f"inner products of {dims} such components do not fit into 62 bits")
        grid[dims] = (np.array(low, np.int64), np.array([-(-(h - x + 1) // n_cells) for x, h in zip(low, high, strict=True)], np.int64))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("m")).first()
    n_rows, n_anchors = max(1, -(-counts.n // sizes[0])), max(1, -(-counts.m // sizes[1]))
    least = max([0, *(max(abs(int(x.min())), abs(int((x + w * n_cells).max()))) for x, w in grid.values() if len(x))])
    kind = "<i2" if least < 1 << 15 else "<i8"

    def packed(batches):
        for pdf in batches:
            cells, exact = [], []
            for v in pdf.vec:
                v = np.asarray(v, np.int64)
                low, width = grid[len(v)]
                cells.append(((v - low) // width).astype(np.uint8).tobytes())
                exact.append(v.astype(kind).tobytes())
            yield pdf.drop(columns="vec").assign(cells=cells, exact=exact)

    h = F.xxhash64(*ids, "vec")
    keyed = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.size("vec").alias("dims"), "anchor", F.pmod(h, F.lit(n_rows)).cast("int").alias("g"), F.pmod(F.xxhash64(h, F.lit(1)), F.lit(n_anchors)).cast("int").alias("a"), "vec")
    return stored(keyed.mapInPandas(packed, _FILE)), grid | {-1: kind}, n_rows, n_anchors


def _arrays(pdf: pd.DataFrame, dims: int, kind: str):
    """Cells, components, ids and labels of a group, in the order of ids."""
    pdf = pdf.sort_values(["vec_id", "rid"])
    read = lambda c, t: np.frombuffer(b"".join(pdf[c]), t).reshape(len(pdf), dims)
    return pdf, read("cells", np.uint8), read("exact", kind).astype(np.int64), pdf.vec_id.to_numpy(), pdf.label.to_numpy()


def _bounds(anchor: np.ndarray, low: np.ndarray, width: np.ndarray, looked: np.ndarray, n_cells: int) -> tuple[np.ndarray, int]:
    """Each row's lower bound of its inner product with the anchor, and how far above it the upper is.

    looked: the rows' cells as places in the table, cells of a dimension side by side."""
    at = low[:, None] + width[:, None] * np.arange(n_cells)  # a cell's least value; its largest is width - 1 above
    table = np.where(anchor[:, None] >= 0, anchor[:, None] * at, anchor[:, None] * (at + width[:, None] - 1))
    return np.take(table.ravel(), looked).sum(1), int((np.abs(anchor) * (width - 1)).sum())


def _grid_join(file: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, run, schema: str) -> DataFrame:
    """run(key, anchors' frame, rows' frame) for every pair of groups of vectors of one length."""
    left = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    right = file.drop("a", "anchor").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    keys = ["g", "a", "dims"]
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of their own, as both sides stem from one file
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def positives(file: DataFrame, grid: dict, n_rows: int, n_anchors: int, k: int, n_cells: int = CELLS) -> DataFrame:
    """(anchor, positive_id, positive_score, place): each anchor's first k other rows of its label."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, dims = [], key[2]
        if len(left) and len(right):
            pdf, cells, exact, ids, labels = _arrays(right, dims, grid[-1])
            low, width = grid[dims]
            of = {x: np.flatnonzero(labels == x) for x in np.unique(labels)}
            looked = cells + np.arange(dims, dtype=np.int64) * n_cells
            _, _, own, own_ids, own_labels = _arrays(left, dims, grid[-1])
            for rid, anchor, me, label in zip(left.sort_values(["vec_id", "rid"]).rid, own, own_ids, own_labels, strict=True):
                some = of.get(label, np.empty(0, np.int64))
                some = some[ids[some] != me]
                if not len(some):
                    continue
                lower, spread = _bounds(anchor, low, width, looked[some], n_cells)
                if len(some) > k:
                    some = some[lower + spread >= np.partition(lower, len(some) - k)[len(some) - k]]
                score = exact[some] @ anchor
                for i in np.lexsort((ids[some], -score))[:k]:
                    out.append((rid, int(pdf.rid.iloc[some[i]]), int(ids[some[i]]), int(score[i])))
        return pd.DataFrame(out, columns=["anchor", "rid", "positive_id", "positive_score"])

    anchors = file.where("anchor").drop("anchor")
    found = _grid_join(file, anchors, n_rows, n_anchors, run, "anchor long, rid long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "rid")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, ids: tuple[str, ...] = ("vec_id", "label"), n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95), n_cells: int = CELLS, sizes: tuple[int, int] = (ROWS, ANCHORS)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each
    of its first positives, the first rows of other labels whose score, in hundredths, lies between
    window[0] and window[1] times the positive's."""
    file, grid, n_rows, n_anchors = approximated(rows, list(ids), n_cells, sizes)
    best = stored(positives(file, grid, n_rows, n_anchors, n_positives, n_cells))
    wanted = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("asked"))
    asked = file.where("anchor").drop("anchor").join(wanted.withColumnRenamed("anchor", "rid"), "rid")
    asked = asked.select(*(c for c in file.columns if c != "anchor"), F.transform("asked", lambda x: x["place"]).alias("places"), F.transform("asked", lambda x: x["positive_score"]).alias("scores"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, dims = [], key[2]
        if len(left) and len(right):
            pdf, cells, exact, ids, labels = _arrays(right, dims, grid[-1])
            rids, (low, width) = pdf.rid.to_numpy(), grid[dims]
            looked = cells + np.arange(dims, dtype=np.int64) * n_cells
            left, _, own, own_ids, own_labels = _arrays(left, dims, grid[-1])
            for rid, anchor, me, label, places, scores in zip(left.rid, own, own_ids, own_labels, left.places, left.scores, strict=True):
                lower, spread = _bounds(anchor, low, width, looked, n_cells)
                other = (labels != label) & (ids != me)
                for place, score in zip(places, map(int, scores), strict=True):
                    least, most = -(-window[0] * score // 100), window[1] * score // 100
                    if least > most:
                        continue
                    may = np.flatnonzero(other & (lower + spread >= least) & (lower <= most))
                    sure = lower[may][(lower[may] >= least) & (lower[may] + spread <= most)]
                    if len(sure) > n_negatives:  # so many are in for certain that lower rows cannot enter
                        may = may[lower[may] + spread >= np.partition(sure, len(sure) - n_negatives)[len(sure) - n_negatives]]
                    exactly = exact[may] @ anchor
                    fits = (exactly >= least) & (exactly <= most)
                    may, exactly = may[fits], exactly[fits]
                    for i in np.lexsort((ids[may], -exactly))[:n_negatives]:
                        out.append((rid, int(place), int(rids[may[i]]), int(ids[may[i]]), int(exactly[i])))
        return pd.DataFrame(out, columns=["anchor", "place", "rid", "negative_id", "negative_score"])

    found = _grid_join(file, asked, n_rows, n_anchors, run, "anchor long, place int, rid long, negative_id long, negative_score long")
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "rid")
    few = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_negatives).drop("rid")
    names = file.where("anchor").select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return few.join(best.drop("rid"), ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

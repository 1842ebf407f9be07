"""Hard negatives against all exact scores, in SQL and by brute force."""

from __future__ import annotations

import math
import random

import pytest

from tallyframe.llm import queries, va_file

SCHEMA = "vec_id long, label int, embedding array<double>, anchor string, g int, cells string"


def plain(rows):
    kept = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
            kept[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * y) for y in x)] = None
    out = []
    for a in kept:
        if a[0] % 50 == 0:
            scored = sorted((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b) for b in kept if b[0] != a[0] and len(b[2]) == len(a[2]))
            for ps, p in [s for s in scored if s[1][1] == a[1]][:5]:
                fits = [s for s in scored if s[1][1] != a[1] and 50 * -ps <= 100 * -s[0] <= 95 * -ps]
                out += [(a[0], p[0], i + 1, n[0], -ps, -ns) for i, (ns, n) in enumerate(fits[:3])]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(3)
    out = va_file.hard_negatives(va_file.mined(df), **more)
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("cells", [3, 64])
def test_random_vectors_in_many_groups(spark, cells):
    rnd = random.Random(cells)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, i % 3, [x + rnd.gauss(0, 0.3) for x in centres[i % 5]]) for i in range(400)]
    assert len(plain(rows)) > 50
    assert found(spark, rows, n_cells=cells, sizes=(40, 3)) == plain(rows)


def test_odd_rows(spark):
    one = [1.0, 2.0]
    rows = [(0, 1, one), (0, 1, one), (0, 2, [0.5, 1.0]), (1, 1, one), (2, 1, one), (3, 1, [1.0, 1.9]), (4, 2, [0.9, 1.7]), (5, 2, [0.9, 1.7]), (6, 3, [0.9, 1.7]), (7, 1, [0.9, 1.5]), (8, 2, [0.0, 0.0]), (9, None, one), (None, 1, one), (10, 1, None), (11, 1, [None, 1.0])]
    rows += [(12, 1, [float("nan"), 1.0]), (13, 1, [float("inf"), 1.0]), (14, 1, []), (50, 2, []), (51, 2, []), (52, 3, []), (15, 1, [1.0, 2.0, 3.0]), (100, 2, [-1.0, -2.0]), (101, 2, [1.0, 2.0]), (16, 9, [-0.5, -1.0])]
    assert found(spark, rows) == plain(rows)


def test_one_label_and_empty(spark):
    assert found(spark, [(i, 1, [1.0, float(i)]) for i in (1, 2, 50)]) == []
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        found(spark, [(0, 1, [1e9, 1e9]), (1, 1, [1e9, 1e9])])


def test_bounds_hold_the_score():
    import numpy as np

    rng = np.random.default_rng(0)
    rows, anchor = rng.integers(-300, 300, (50, 8)), rng.integers(-300, 300, 8)
    low = rows.min(0)
    width = -(-(rows.max(0) - low + 1) // va_file.CELLS)
    looked = (rows - low) // width + np.arange(8) * va_file.CELLS
    lower, spread = va_file._bounds(anchor, low, width, looked, va_file.CELLS)
    assert ((lower <= rows @ anchor) & (rows @ anchor <= lower + spread)).all()


def test_query(spark, compare):
    own, other = compare(queries.queries()["op13_va_file"], queries.oracle_sql()["op13_va_file"], "/root/testdata/sf0.01")
    assert own == other and own

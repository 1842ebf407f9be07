from __future__ import annotations

import random

import numpy as np
import pytest

from tallyframe.llm import common, exact_dedup, minhash, queries, shingles

DATA = "/root/testdata/sf0.001"


def linked(ids, near):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_chunk_hashes_combine():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20000, dtype=np.uint8).tobytes()
    parts = [data[:1], data[1:5000], data[5000:5000], data[5000:]]
    rows = [(len(p), *(exact_dedup.chunk_hash(p, q, x) for q, x in zip(exact_dedup.PRIMES, exact_dedup.POINTS))) for p in parts]
    total = (0, 0, 0)
    for r in rows:
        total = exact_dedup.combine(total, r)
    h = 0
    for b in data:
        h = (h * exact_dedup.POINTS[0] + b) % exact_dedup.PRIMES[0]
    assert total[0] == len(data) and total[1] == h == exact_dedup.chunk_hash(data, exact_dedup.PRIMES[0], exact_dedup.POINTS[0])


def test_exact_matches_sql(spark, compare):
    own, other = compare(queries.queries()["op8_exact_dedup"], queries.oracle_sql()["op8_exact_dedup"], DATA)
    assert own == other


@pytest.mark.parametrize("options", [{}, {"chunk": 7}, {"primes": (2, 3)}], ids=["plain", "chunked", "collisions"])
def test_exact_odd_rows(odd, options):
    rows = exact_dedup.exact_dedup(odd, **options).collect()
    assert len(rows) == 15
    got = {r.doc_id: r for r in rows}
    assert got[1].keep_id == 3 and got[None].keep_id == 3 and got[3].kept and got[1].group_size == 4  # longest original, both rows of 3
    assert got[2].keep_id == 2 and got[4].keep_id == got[5].keep_id == 6 and got[5].group_size == 3
    assert got[7].keep_id == got[8].keep_id == 7 and got[11].keep_id == got[12].keep_id == 11


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert minhash.minhash_dedup(empty).count() == 0


def test_minhash_equals_brute_force(small):
    texts = {r.doc_id: r.text for r in small.collect()}

    def words(t):
        return [w for w in t.translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in texts.items()}
    wanted = linked(sorted(sets), lambda a, b: len(sets[a] & sets[b]) > 0 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = {r.doc_id: r for r in minhash.minhash_dedup(small).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_minhash_odd_rows(odd):
    rows = minhash.minhash_dedup(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 15
    assert [got[i].component_id for i in (1, 2, 3, 10)] == [1, 1, 1, 1] and got[8].component_id == 7 and got[12].component_id == 11
    assert all(got[i].n_shingles == 0 and got[i].kept and got[i].component_id == i for i in (4, 5, 6))
    assert got[None].component_id is None and got[None].kept


def test_minhash_chain_in_one_bucket(spark):
    """Neighbours in a chain of edits are near, its ends are not: all must be one component, and others apart."""
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
    rows += [(100 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles.shingle_set(t) for i, t in rows}
    wanted = linked(sorted(sets), lambda a, b: 100 * (n := shingles.shared(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n))
    assert {r.doc_id: r.component_id for r in minhash.minhash_dedup(df).collect()} == wanted


def test_minhash_repeated_ids(spark):
    """A doc_id with a copy of another's text and a text of its own: each row is judged by its text."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (7, b + " more")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.minhash_dedup(rows).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (7, 5, False)]


def test_minhash_members_outside_the_main_component(spark, monkeypatch):
    """All classes in shared buckets, several clusters and loners: small blocks give the brute-force components."""
    for name, value in (("PROBES", 3), ("TARGETS", 4), ("OUTSIDE", 3), ("BESIDE", 2)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(6):
        text = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        for _ in range(rng.randrange(2, 7)):
            rows.append((n, " ".join(text)))
            text[rng.randrange(40)] = f"e{rng.randrange(10**6)}"
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = [(i, minhash.signature(shingles.shingle_set(t)).astype(np.uint8).tobytes()) for i, t in rows]
    sets = {i: shingles.shingle_set(t) for i, t in rows}
    wanted = linked(sorted(sets), lambda a, b: 100 * (x := shingles.shared(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - x))
    mixed = spark.createDataFrame([(k, i, i, -1) for k in (1, 2) for i, _ in rows], "key long, id long, comp long, main long")
    found = minhash.outside_links(mixed, spark.createDataFrame(sigs, "id long, sig binary"), df)
    got = {r.id: r.component_id for r in minhash.joined_labels(spark.createDataFrame([], "id long, component_id long"), found).collect()}
    assert {i: got.get(i, i) for i in wanted} == wanted


def test_bayes_bound():
    assert minhash.missed(minhash.NEEDED, 0.75) <= minhash.MISS and all(least > 0 for _, least in minhash.NEEDED)
    assert minhash.least_matches(288, 0.75, 1e-6) < 288 * 0.75
    assert [m for _, m in minhash.NEEDED] == sorted(m for _, m in minhash.NEEDED)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component_id for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_components_raise_when_rounds_run_out(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.components(edges, rounds=1)


def test_texts_go_to_python_in_small_batches(spark):
    import pyarrow as pa

    from tallyframe.llm import common

    def sizes(batches):
        for t in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t.num_rows])], names=["n"])

    before = spark.conf.get(common.BATCH_ROWS)
    df = spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long")
    assert max(r.n for r in common.stored(df).collect()) == 2500
    assert sorted(r.n for r in common.stored(df, common.TEXTS).collect()) == [500, 1000, 1000]
    assert spark.conf.get(common.BATCH_ROWS) == before

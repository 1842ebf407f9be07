from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, odd, empty):
    for docs, ends in ((odd, None), (empty, 0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "packing":
                assert out.columns == docs.columns
                assert out.count() <= n
                docs, n = spark.createDataFrame(out.collect(), docs.schema), out.count()
            else:
                assert out.count() >= n
        if ends is not None:
            assert n == ends
        else:
            left = {r.doc_id for r in docs.collect()}
            assert not {4, 5, 6, 9} & left and len({1, 2, 3, 10} & left) == 1 and len({7, 8} & left) == 1 and len({11, 12} & left) == 1


def survivors(rows):
    """What the stages before packing keep, by brute force on (doc_id, text, ...) rows."""
    import regex

    rows = [r for r in rows if r.text is not None and regex.search(r"\p{L}", r.text)]
    groups = {}
    for r in rows:
        groups.setdefault(r.text.translate({ord(c): None for c in " \t\n\x0b\x0c\r"}), []).append(r)
    rows = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()]
    low = {c: c + 32 for c in range(65, 91)}

    def shingles(t):
        w = regex.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {r.doc_id: shingles(r.text) for r in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {r.doc_id: r.text for r in rows if label[r.doc_id] == r.doc_id}


def test_run_equals_brute_force(spark):
    """The whole pipeline: the documents that stay, and every token of theirs in one piece, in sequences that are full enough."""
    from .test_others import check_packing

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    packed, wanted = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect(), survivors(rows)
    assert {r.doc_id for r in packed} == set(wanted)
    assert check_packing(packed, wanted) < 0.05 * sum(r.length for r in packed) + 2048


def test_a_text_of_a_repeated_id_is_not_lost(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(3, a), (5, a + " z"), (5, b), (5, b), (None, b + " y"), (None, b + " y")], "doc_id long, text string").withColumn("g_id", F.lit(1)).withColumn("p_position", F.lit(2))
    left = corpus_pipeline.near_unique(spark, docs, "")
    assert left.columns == docs.columns and sorted(map(str, (r[:2] for r in left.collect()))) == sorted(map(str, [(3, a), (5, b), (None, b + " y"), (None, b + " y")]))
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.exact_unique(spark, docs, "").collect()))) == ["3", "5", "5", "None"]
    assert corpus_pipeline.mixed(spark, docs.withColumn("source", F.lit("s")), "").count() == 6


def test_sequences_follow_the_target_weights(spark):
    """Sources of 4096 and 1024 documents have weights of 2/3 and 1/3 until the second runs out, after 3072 documents."""
    rows = [(i, " ".join(["word"] * (20 + i * 7919 % 97)), "small" if i % 5 == 0 else "large") for i in range(5120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed = corpus_pipeline.packed(spark, docs, "").collect()
    assert len(packed) == 5120 and sorted({r.sequence_id for r in packed}) == list(range(max(r.sequence_id for r in packed) + 1))
    source, seen, small, checked = {i: s for i, _, s in rows}, 0, 0, 0
    for r in sorted(packed, key=lambda r: r.sequence_id):
        seen += 1
        small += source[r.doc_id] == "small"
        if 500 <= seen <= 2800:
            checked += 1
            assert abs(small / seen - 1 / 3) < 0.03
    assert checked == 2301

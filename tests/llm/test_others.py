from __future__ import annotations

import math
import os
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import covertree, language_id, line_dedup, lm_score, mixing, packing, queries, url_filter, warc

DATA = "/root/testdata/sf0.001"


def check_packing(rows, texts, size=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    return sum(size - sum(r.length for r in own) for own in bins.values())


def test_packing_covers_every_token_once(small):
    texts = {r.doc_id: r.text for r in small.collect()}
    rows = packing.pack(small).collect()
    padding = check_packing(rows, texts)
    assert padding < 0.05 * sum(r.length for r in rows)


def test_packing_odd_rows(odd, empty):
    once = odd.dropDuplicates(["doc_id"])
    check_packing(packing.pack(once).collect(), {r.doc_id: r.text for r in once.collect()})
    assert packing.pack(odd).select("doc_id", "sequence_id", "offset").where("doc_id = 3").distinct().count() == 2  # repeated rows are packed twice
    assert packing.pack(empty).count() == 0


def test_patterns_cover_the_demand_near_its_bound():
    rng = np.random.default_rng(0)
    sizes, counts = np.unique(np.clip(rng.lognormal(4, 1, 5000).astype(int), 1, 256), return_counts=True)
    demand = dict(zip(sizes.tolist(), counts.tolist()))
    used = packing.solve(demand, 256)
    total = Counter()
    for pattern, n in used:
        assert sum(s * k for s, k in pattern.items()) <= 256
        total.update({s: k * n for s, k in pattern.items()})
    assert dict(total) == demand
    assert sum(n for _, n in used) <= math.ceil(sum(s * n for s, n in demand.items()) / 256) + len(used)
    assert packing.solve({}, 256) == []


@pytest.mark.parametrize("text", ["", "a\tb\x1cc ÉCOLE é don't ﬁ 12.5 z\n\nʼn Σας İx ǅ º²", "<|endoftext|>y", "\x1c"])
def test_token_parts_give_the_texts_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.token_bytes([text], "word_bpe_49k.json")[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got >= 0.98


def test_language_id_odd_rows(odd, empty):
    got = {r.doc_id: r for r in language_id.language_id(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 9))
    assert got[1].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.language_id(empty).count() == 0


def test_mixture_finds_both_languages():
    docs = {"a": "der hund und die katze sind schon lange hier in dem haus " * 20, "b": "the dog and the cat are now for some time here in that house " * 20}
    model = np.full((language_id.TRIGRAMS, 2), 0.5)
    for i, t in enumerate(docs.values()):
        cells, n = language_id.trigram_counts(t)
        model[cells, i] += n
    model /= model.sum(0)
    assert [k for k, _ in language_id.infer(model, docs["a"])] == [0]
    both = dict(language_id.infer(model, docs["a"] + docs["b"]))
    assert set(both) == {0, 1} and abs(both[0] - 0.5) < 0.1


def test_lm_base_scores_and_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    low = {c: c + 32 for c in range(65, 91)}
    tokens = {i: [*filter(None, t.translate(low).replace("\n", " ").replace("\t", " ").split(" ")), None] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = lm_score.lm_score(docs).collect()
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd_rows(odd, empty):
    rows = lm_score.lm_score(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 15 and got[4].n_tokens == got[5].n_tokens == got[6].n_tokens == 1 and all(r.score < 0 for r in rows)
    assert lm_score.lm_score(empty).count() == 0


def test_lm_predictions_sum_to_one(spark):
    """Scores of one-token continuations: the probabilities of the end after each known or unknown word, and of those words."""
    docs = spark.createDataFrame([(i, "a b a c a b") for i in range(40)] + [(10_000 + i, t) for i, t in enumerate(("", "a", "b", "c", "zzz"))], "doc_id long, text string")
    from tallyframe.llm.lm_score import score_texts

    got = {r.doc_id: 10**r.score for r in score_texts(docs, F.col("doc_id") >= 10_000).collect()}
    # P(end | start) + sum over w of P(w | start): from P(w end) / P(end | w) is not observable here, so only bounds hold
    assert 0 < got[10_000] < 1 and got[10_001] > got[10_003] and got[10_001] > got[10_004] and sum(got[10_000 + k] for k in range(5)) < 1


def test_lm_moves_each_pair_once(spark):
    """Pairs are shuffled once, not for counting, for the model and for the question: under 11 times the documents' size."""
    path = "/root/testdata/sf0.01/documents.parquet"
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    assert lm_score.lm_score(spark.read.parquet(path)).agg(F.count("score")).first()[0] == 1000
    assert moved() - before < 11 * os.path.getsize(path)


@pytest.mark.parametrize("many", [3, 70_000])
def test_lm_groups_find_the_runs_pairs(many):
    """Two runs' pairs and words among a group's, by brute force: counts from 255 on, pairs that occur in held-out texts only, many words."""
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(1 << 40, 1 << 63, many + 5).astype(np.uint64))
    runs = []
    for _ in range(2):
        said = np.sort(rng.choice(words, many, replace=False))
        reps = rng.integers(1, 4, many)
        reps[0] = 300
        u = np.concatenate([np.sort(rng.choice(1000, k, replace=False)) for k in reps]).astype(np.uint64)
        runs.append((said, reps, u, rng.choice([0, 1, 2, 255, 70_000], len(u))))
    bounds = lambda x: np.array([0, len(x)])
    cut = [[r[0].tobytes(), *(x[0].as_py() for x in lm_score._cut_small(r[1], bounds(r[1]))), lm_score._narrow(r[2]).tobytes(), *(x[0].as_py() for x in lm_score._cut_small(r[3], bounds(r[3])))] for r in runs]
    pdf = pd.DataFrame([[0, k, *x, *[None] * 5] for k, x in enumerate(cut)], columns=lm_score._names(lm_score.DEALT))
    sent = types.SimpleNamespace(value=lm_score._Groups(1, np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    row = lm_score._merge(sent)(pdf).iloc[0]
    pairs = [list(zip(np.repeat(r[0], r[1]).tolist(), r[2].tolist(), strict=True)) for r in runs]
    counts = Counter()
    for own, r in zip(pairs, runs, strict=True):
        counts.update({k: n for k, n in zip(own, r[3].tolist(), strict=True) if n})
    n, known = lm_score._from_planes(row["n"]), sorted({w for w, _ in counts})
    assert n.tolist() == [counts[k] for k in sorted(counts)] and row.n_all == sum(counts.values()) and row.v_all == len(known)
    at = lm_score._places(row.pair_refs, lm_score._from_planes(row.pairs), len(n) + 1)
    assert np.append(0, n)[at].tolist() == [counts[k] for own in pairs for k in own]
    at = lm_score._places(row.word_refs, lm_score._from_planes(row.words), len(known) + 1)
    there = set(known)
    assert np.append(np.uint64(0), np.array(known, np.uint64))[at].tolist() == [w if w in there else 0 for r in runs for w in r[0].tolist()]


def test_seating_follows_the_chain():
    """Numbers of tables against customers who come one by one, for few and many customers."""
    rng = np.random.default_rng(0)
    c = np.array([1.0, 2, 10, 1000, 10**9, 0])
    t, z = lm_score.seat(c, 0.5, np.full(6, 0.5), np.full(6, 0.1), rng)
    assert ((t >= np.minimum(c, 1)) & (t <= c)).all() and np.isfinite(z).all()
    for n, weight, step in ((2, 0.5, 0.0), (5, 0.3, 0.2), (300, 2.0, 0.1)):
        wanted = []
        for _ in range(2000):
            tables = 1
            for j in range(1, n):
                new, old = weight + step * tables, j - 0.5 * tables
                tables += rng.random() < new / (new + old)
            wanted.append(tables)
        got = lm_score.seat(np.full(20000, float(n)), 0.5, np.full(20000, weight), np.full(20000, step), rng)[0]
        assert got.mean() == pytest.approx(np.mean(wanted), rel=0.05) and got.std() == pytest.approx(np.std(wanted), rel=0.1)


def sequential_seating(train, held, sweeps=60, burn=20):
    """A plain Gibbs sampler of the two-level model, a customer at a time: mean probability of each (context, word)."""
    import random

    rng, grid = random.Random(5), lm_score.GRID.tolist()
    pairs = [(u, w) for t in train for u, w in zip(["^", *t], [*t, "$"])]
    seen = Counter(pairs)
    words, follow = {w for _, w in pairs}, Counter(w for _, w in seen)
    d2 = min(0.95, max(0.05, (n1 := sum(n == 1 for n in seen.values())) / max(1, n1 + 2 * sum(n == 2 for n in seen.values()))))
    d1 = min(0.95, max(0.05, (n1 := sum(n == 1 for n in follow.values())) / max(1, n1 + 2 * sum(n == 2 for n in follow.values()))))
    base, a1, a2 = 1 / (len(words) + 1), 1.0, 1.0
    low, top, tables, customers, s, n = defaultdict(list), defaultdict(list), Counter(), Counter(), 0, 0

    def p_top(w):
        return (sum(top[w]) - d1 * len(top[w]) + (a1 + d1 * s) * base) / (a1 + n)

    def p_low(u, w):
        own = low[u, w]
        return (sum(own) - d2 * len(own) + (a2 + d2 * tables[u]) * p_top(w)) / (a2 + customers[u])

    def sit(sizes, d, new):
        weights = [x - d for x in sizes] + [new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(sizes):
            sizes.append(0)
        sizes[k] += 1
        return k == len(sizes) - 1 and sizes[k] == 1

    def leave(sizes):
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def add(u, w):
        nonlocal s, n
        if sit(low[u, w], d2, (a2 + d2 * tables[u]) * p_top(w)):
            tables[u] += 1
            s += sit(top[w], d1, (a1 + d1 * s) * base)
            n += 1
        customers[u] += 1

    def remove(u, w):
        nonlocal s, n
        customers[u] -= 1
        if leave(low[u, w]):
            tables[u] -= 1
            s -= leave(top[w])
            n -= 1

    def drawn(d, rooms):
        value = [sum(math.lgamma(x / d + t) - math.lgamma(x / d) - math.lgamma(x + c) + math.lgamma(x) for t, c in rooms) for x in grid]
        return rng.choices(grid, [math.exp(v - max(value)) for v in value])[0]

    for u, w in pairs:
        add(u, w)
    asked = [[(u, w) for u, w in zip(["^", *t], [*t, "$"])] for t in held]
    mean = defaultdict(float)
    for k in range(sweeps):
        for u, w in pairs:
            remove(u, w)
            add(u, w)
        a2, a1 = drawn(d2, [(tables[u], customers[u]) for u in customers]), drawn(d1, [(s, n)])
        if k >= burn:
            for q in {q for t in asked for q in t}:
                mean[q] += p_low(*q) / (sweeps - burn)
    return [sum(math.log10(mean[q]) for q in t) for t in asked]


def test_lm_scores_equal_a_sequential_sampler(spark):
    """Texts of a small bigram language, those held out with unknown words too: scores agree within a few hundredths a token."""
    import random

    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    likes = {w: rng.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=6) for w in vocabulary}

    def text():
        out = [rng.choice(vocabulary)]
        for _ in range(rng.randrange(3, 25)):
            out.append(rng.choice(likes[out[-1]]) if rng.random() < 0.8 else rng.choice(vocabulary))
        return out

    train, held = [text() for _ in range(120)], [text() for _ in range(30)] + [["new", "w1", "w2"], []]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(train + held)], "doc_id long, text string")
    wanted = sequential_seating(train, held)
    for group in (2_000_000, 50):  # whole words, and words split over groups
        got = {r.doc_id: r.score for r in lm_score.score_texts(df, F.col("doc_id") >= len(train), group=group).collect()}
        off = [(got[len(train) + i] - x) / (len(held[i]) + 1) for i, x in enumerate(wanted)]
        assert abs(float(np.mean(off))) < 0.02 and max(map(abs, off[:30])) < 0.1 and max(map(abs, off)) < 0.3, off


def brute_vectors(rows):
    good = [r for r in rows if r[1] is not None and r[2] is not None and r[0] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: 0 for r in rows}
    label = {r[0]: r[0] for r in rows}
    near = defaultdict(set)
    for a in good:
        for b in good:
            if a is not b and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.93:
                    links[a[0]] += 1
                    near[a[0]].add(b[0])
    for _ in rows:
        for i in near:
            label[i] = min([label[i], *(label[j] for j in near[i])])
    return links, label


@pytest.mark.parametrize(("cell", "block"), [(1000, 4096), (20, 4096), (4, 8)])
def test_covertree_equals_brute_force(spark, cell, block, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "CENTRES", 6 if block == 8 else 4096)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * (0.02 if i % 3 else 0.3)).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(5)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 0), (303, rows[1][1], None), (304, [1.0, None], 0), (305, [], 0), (306, [1.0, 2.0], 0), (307, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1)).withColumn("grp", F.lit("x")).repartition(4)
    got = {r.vec_id: r for r in covertree.covertree_dedup(df, cell=cell).collect()}
    links, label = brute_vectors(rows)
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == label


def test_covertree_stretched_cell_beside_a_tight_one(spark):
    """Members of the tight cell are not inside the stretched one, whose near members are inside the tight one."""
    angles = (0.0, 0.10, 0.01, 0.02, 0.08, 2.0)
    turned = [(k, i, [math.cos(a + k / 100), math.sin(a + k / 100)]) for k in range(300) for i, a in enumerate(angles)]
    draw = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 40))
    drawn = spark.createDataFrame(turned, "k int, i int, v array<double>").select("k", F.struct(draw.alias("draw"), "i").alias("d")).groupBy("k").agg(F.sort_array(F.collect_list("d")).alias("d")).orderBy("k").collect()
    k = next(r.k for r in drawn if {r.d[0].i, r.d[1].i} == {0, 1})  # a turn at which the first two are the sampled centres
    ids = list(range(6))
    rows = [(i, v, 0) for at, i, v in turned if at == k]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in covertree.covertree_dedup(df, cell=3).collect()}
    links, label = brute_vectors(rows)
    assert [got[i].n_links for i in ids] == [4, 4, 4, 4, 4, 0]
    assert {i: r.n_links for i, r in got.items()} == links and {i: r.component_id for i, r in got.items()} == label


def test_covertree_leaves_unstructured_points_alone(monkeypatch):
    """Points that halving does not compress are a leaf after a few distances, not after one for each eighth point."""
    calls, distance = [], covertree._distance
    monkeypatch.setattr(covertree, "_distance", lambda a, b: calls.append(1) or distance(a, b))
    x = np.random.default_rng(1).normal(size=(4000, 64))
    node = covertree.Node(covertree._unit(x), np.arange(4000))
    assert not node.children and len(calls) < 50


@pytest.mark.parametrize("lot", [7, 1000])
def test_covertree_visitors_pass_in_lots(lot, monkeypatch):
    """Links of held classes and of visitors, counted for both ends, with pairs beside the threshold that single precision cannot tell."""
    import pyarrow as pa

    for name, value in {"VISITORS": lot, "HELD": 50, "LEAF": 8, "COMPRESSED": 2}.items():
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    x = np.concatenate([centres[np.arange(60) % 5] + rng.normal(size=(60, 6)) * np.where(np.arange(60) % 2, 0.05, 0.4)[:, None], rng.normal(size=(20, 6))])
    for k, off in enumerate((1e-9, -1e-9, 1e-12, -1e-12)):
        u, w = np.eye(6)[k], np.eye(6)[k + 1]
        x = np.concatenate([x, [u, (0.93 + off) * u + math.sqrt(1 - (0.93 + off) ** 2) * w]])
    order = rng.permutation(len(x))
    x, n, mult = x[order], 40, rng.integers(1, 4, len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    near[n:, n:] = False  # visitors do not meet each other
    rows = [{"grp": "g", "cell": 0, "block": 0, "own": i < n, "rep": 100 + i, "mult": int(mult[i]), "bulk": 0.0, "sure": [] if i < n else None, "v": x[i].tolist()} for i in range(len(x))]
    kinds = {"grp": pa.string(), "own": pa.bool_(), "bulk": pa.float64(), "sure": pa.list_(pa.int64()), "v": pa.list_(pa.float64())}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in rows[0]])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 9], schema) for i in range(0, len(rows), 9)]
    found = [r for b in covertree._link(0.93)(iter(batches)) for r in b.to_pylist()]
    linked = {r["rep"] - 100: r["linked"] for r in found}
    assert len(found) == len(linked) and {i: linked.get(i, 0) for i in range(len(x))} == dict(enumerate((near @ mult).tolist()))
    label, told = list(range(len(x))), list(range(len(x)))
    for _ in x:
        for i in range(len(x)):
            label[i] = min(label[i], *(label[j] for j in near[i].nonzero()[0]), len(x))
        for r in found:
            for j in r["near"]:
                told[r["rep"] - 100] = told[j - 100] = min(told[r["rep"] - 100], told[j - 100])
    assert told == label


def test_covertree_one_id_in_two_classes(spark):
    """Orthogonal vectors with one vec_id do not link, and what one of them links with is no link of the other."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [-1.0, 0.0], 0), (3, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in covertree.covertree_dedup(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3)]


def test_covertree_empty_and_null_id(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert covertree.covertree_dedup(df).count() == 0
    r = covertree.covertree_dedup(spark.createDataFrame([(None, [1.0], 0)], "vec_id long, embedding array<float>, label int")).first()
    assert (r.n_links, r.component_id, r.kept) == (0, None, True)


def test_warc_and_lines_match_sql(compare):
    q, sql = queries.queries(), queries.oracle_sql()
    for name in ("op6_warc_revisits", "op7_line_dedup"):
        own, other = compare(q[name], sql[name], DATA)
        assert own == other


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        ("r1", "http://WWW.a.com:80/x/?utm_source=z&b=1&a=2#f", 10, "response", 200, "e1", None, "d1", 5, h(content_length="5", server="s", age="0")),
        ("r2", "http://a.com/x?a=2&b=1", 20, "response", 200, "e2", None, "d2", 6, h(content_length="6")),
        ("v1", "https://a.com/x?b=1&a=2", 15, "revisit", 304, "e1", None, None, None, h(content_length="0", age="9")),
        ("v2", "http://a.com/x?a=2&b=1", 25, "revisit", 304, "e1", None, None, None, None),
        ("v3", "http://a.com/x?a=2&b=1", 5, "revisit", 304, "e1", None, None, None, None),
        ("v4", None, 50, "revisit", 304, "e1", None, None, None, None), ("v5", "http://a.com/x?a=2&b=1", None, "revisit", 304, "e1", None, None, None, None), ("v6", "http://a.com/x?a=2&b=1", 30, "revisit", 304, None, None, None, None, None),
        ("r3", "http://a.com/x?a=2&b=1", 40, "response", 500, "e9", None, "d9", 1, None), ("v7", "http://a.com/x?a=2&b=1", 45, "revisit", 304, "e2", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, status int, etag string, last_modified string, payload_digest string, payload_length long, headers map<string,string>").withColumn("found", F.lit("clash"))
    for slices in (2, 64):
        got = {r.record_id: r for r in warc.resolve_revisits(df, slices).collect()}
        assert {k: (r.outcome, r.resolved_id) for k, r in got.items()} == {
            "v1": ("resolved", "r1"), "v2": ("validator_mismatch", None), "v3": ("no_earlier", None), "v4": ("no_earlier", None), "v5": ("no_earlier", None), "v6": ("validator_mismatch", None), "v7": ("resolved", "r2"),
        }
        assert got["v1"].headers == {"content-length": "5", "server": "s", "age": "9"} and got["v1"].payload_digest == "d1"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_line_dedup(spark):
    pages = [(i, "http://h.com/p", f"<nav>Home</nav><p>text {i}</p><script>x</script><p>rare</p>" if i < 2 else f"<nav>Home</nav><p>text {i}</p>") for i in range(10)]
    pages += [(20, None, "<p>alone</p>"), (None, "http://h.com/q", None), (21, "http://g.com", "<p>Home</p>"), (21, "http://g.com", "<p>Home</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("marks", F.lit(1))
    got = line_dedup.drop_boilerplate(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 14 and by[0].text == "text 0\nrare" and by[5].text == "text 5" and by[20].text == "alone" and by[None].text == "" and by[21].text == "Home"
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_pagerank_equals_dense_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 2.0)]
    df = spark.createDataFrame([("k", *e) for e in edges], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("k", "a", 0.5), ("k", "d", 0.5)], "kind string, host string, seed double")
    got = {r.host: r["rank"] for r in url_filter.propagate(df, seeds, 0.85, 12).collect()}
    names = "abcd"
    w = np.zeros((4, 4))
    for s, t, x in edges:
        w[names.index(s), names.index(t)] = x
    w = np.divide(w, w.sum(1, keepdims=True), where=w.sum(1, keepdims=True) > 0, out=np.zeros_like(w))
    seed = np.array([0.5, 0, 0, 0.5])
    r = seed
    for _ in range(12):
        r = 0.85 * r @ w + 0.15 * seed
    assert [got.get(n, 0.0) for n in names] == pytest.approx(r.tolist())


def test_pagerank_converges(spark):
    edges = spark.createDataFrame([("k", "a", "b", 1.0), ("k", "b", "a", 1.0)], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("k", "a", 1.0)], "kind string, host string, seed double")
    got = {r.host: r["rank"] for r in url_filter.propagate(edges, seeds).collect()}
    assert got == pytest.approx({"a": 1 / 1.85, "b": 0.85 / 1.85}, abs=1e-5)


def test_url_rules_and_propagation(spark):
    pages = [
        (1, "http://X.Example.com/en/7?q", ""), (2, "http://x.example.com/en/8", ""), (3, "http://a.net/de/1", ""), (4, "http://b.example.net/de/8x", ""), (5, "http://good.org/fr/1", '<a href="http://a.net/">'), (6, "nohost", None), (7, None, None),
        (8, "http://bad.info/x", '<a href="http://evil.org/es/1">'), (9, "http://evil.org/es/2", ""), (9, "http://evil.org/es/2", ""), (10, "http://com/en/", ""), (11, "http://telecom/en/", ""), (None, "http://lonely.dev#x", ""), (12, "http://liked.io/", ""), (13, "http://a.net/de/2", '<a href="http://liked.io/">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rank", F.lit(1))
    rows = url_filter.filter_urls(df).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 15
    assert got[1] == ("x.example.com", "/en/7", "example.com/en/7", "allow") and got[2] == ("x.example.com", "/en/8", "com/en/", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8][2:] == (None, "block") and got[9][2:] == ("org/es/", "block") and got[10][2:] == ("com/en/", "block") and got[11][2] is None and got[12][3] == "allow" and got[None] == ("lonely.dev", "", None, "allow")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_pfair_deviation_is_less_than_a_block():
    parts = mixing.whole_weights({"a": 5, "b": 3, "c": 1.7, "d": 0.01}, 1000)
    assert sum(parts.values()) == 1000 and min(parts.values()) >= 1
    slots, done = mixing.period(parts), Counter()
    for t, k in enumerate(slots, 1):
        done[k] += 1
        assert all(abs(done[s] - t * parts[s] / 1000) < 1 for s in parts)
    assert done == parts


def test_mixing_follows_weights_that_are_no_thousandths(spark):
    from fractions import Fraction

    share = {"a": 0.50025, "b": 0.49955, "c": 0.0002}
    exact = {k: Fraction(repr(w)) for k, w in share.items()}
    counts = {"a": 6000, "b": 6000, "c": 3}
    df = spark.range(12003).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") < 6000, "a").when(F.col("id") < 12000, "b").otherwise("c").alias("source"))
    got = sorted((r.slot, r.source) for r in mixing.schedule(df, share, block=1).collect())
    done = Counter()
    for t, (slot, k) in enumerate(got, 1):
        done[k] += 1
        assert slot == t - 1 and all(abs(done[s] - t * w) < 1 for s, w in exact.items())
        if done[k] == counts[k]:  # a source runs out
            break
    assert t > 10_000


def test_mixing_more_sources_than_two_thousand(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), (F.col("id") % 2500).cast("string").alias("source"))
    assert mixing.schedule(df, block=1).select("position").distinct().count() == 6000


def test_mixing_places_every_row_once(spark, odd, empty):
    rows = spark.createDataFrame([(i, f"t{i}", "big" if i % 3 else ("mid" if i % 2 else "tiny")) for i in range(3000)], "doc_id long, text string, source string")
    share = {"big": 0.5, "mid": 0.3, "tiny": 0.2}
    got = mixing.schedule(rows, share).collect()
    assert len(got) == 3000 and len({r.position for r in got}) == 3000
    slots = {(r.slot, r.source, r.block) for r in got}
    assert sorted(s for s, _, _ in slots) == list(range(len(slots)))
    order, done = [s for _, s, _ in sorted(slots)], Counter()
    for t, k in enumerate(order, 1):
        done[k] += 1
        if max(done["mid"], done["tiny"]) > 31:  # a source runs out: the others go on by themselves
            break
        assert all(abs(done[s] - t * w) < 1 for s, w in share.items())
    assert t > 90
    assert mixing.schedule(odd).count() == 15 and mixing.schedule(empty).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "other"])
def test_other_tokenizers_encode_whole_texts(name, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    if name == "other":
        spec = json.load(open(path, encoding="utf-8"))
        spec["normalizer"] = None
        path = str(tmp_path / "other.json")
        json.dump(spec, open(path, "w", encoding="utf-8"))
    text = "Some Words, ÉCOLE don't 12"
    assert packing.token_bytes([text], path)[0] == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_random_texts_give_the_tokenizers_ids():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    texts = ["".join(rng.choice("aB'st,.!<|>éÉüß12 \n\t½²ªİıſ-_@ ́中") for _ in range(rng.randrange(40))) for _ in range(1000)]
    assert packing.token_bytes(texts, "word_bpe_49k.json") == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

"""Encoding by halves and joins against the library's own encoding of whole texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallyframe.llm import bpe_tree, queries

PARTS = ["a", "b", "the", "in", "aaaa", "'", "s", "'s", "'re", " ", "\n", "1", "!", "==", "é", "é", "́", "̣", "한", "ᄒ", "ᅡ", "ᆫ", "😀", "<|endoftext|>", "<|", "|>", "İ", "ß", "the quick brown ", "中文", "Σ", "ing", " ", "\t"]


@pytest.fixture(scope="module")
def model():
    return bpe_tree.tokenizer(bpe_tree.VOCABULARY)


@pytest.mark.parametrize("seed", range(60))
def test_joins_give_the_librarys_ids(model, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(bpe_tree, "WINDOW", rnd.choice([1, 4, 16]))
    some = rnd.sample(PARTS, rnd.choice([2, 3, 5, 30]))
    text = "".join(rnd.choice(some) for _ in range(rnd.choice([20, 80, 300])))
    half = rnd.choice([3, 20, 50])
    edges = bpe_tree.cuts(len(text), half)
    parts = [bpe_tree.encoded(model[0], text[a:b], a) for a, b in zip(edges, edges[1:], strict=False)]
    assert bpe_tree.concatenated(*model, text, parts, edges).ids.tolist() == model[0].encode(text, add_special_tokens=False).ids


def test_a_word_without_end_is_joined_inside(model, monkeypatch):
    text, asked = "ab" * 20000 + "c" * 10000 + "thequickbrownfox" * 1000, []
    edges = bpe_tree.cuts(len(text), 4096)
    parts = [bpe_tree.encoded(model[0], text[a:b], a) for a, b in zip(edges, edges[1:], strict=False)]
    whole, encoded = model[0].encode(text, add_special_tokens=False).ids, bpe_tree.encoded
    monkeypatch.setattr(bpe_tree, "encoded", lambda m, t, at: asked.append(len(t)) or encoded(m, t, at))
    assert bpe_tree.concatenated(*model, text, parts, edges).ids.tolist() == whole
    assert max(asked) < len(text) / 2  # windows end at tokens that both sides have


@pytest.mark.parametrize("text", ["It's a b c  d\ne 12! <|endoftext|> naïve " + "x" * 100, "", " ", "plain", "a\tb ", "é", "É!! 's'S ſ"])
def test_halves_by_stretches(model, text):
    got, want = bpe_tree.halved(bpe_tree.VOCABULARY, text), bpe_tree.encoded(model[0], text, 0)
    assert all((getattr(got, c) == getattr(want, c)).all() for c in ("ids", "start", "end")) and (np.diff(got.word) > 0).tolist() == (np.diff(want.word) > 0).tolist()


def test_cuts():
    assert bpe_tree.cuts(0, 8) == [0, 0]
    assert bpe_tree.cuts(17, 8) == [0, 4, 8, 12, 17]


def test_query_is_the_librarys(spark, model, tmp_path):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.queries()["op12_bpe_tree"](spark, folder).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = model[0].encode(text, add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(model[0].decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("sizes", [{}, {"whole": 16, "half": 8}])
def test_odd_rows(odd, model, sizes):
    odd = odd.where("text is null or length(text) < 1000") if sizes else odd  # not tens of thousands of halves
    rows = bpe_tree.encode(odd, **sizes).collect()
    want = sorted((str(r.doc_id), np.array(model[0].encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in odd.collect())
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == want  # repeated rows and the null id as often as they are there


def test_empty_and_null(empty, spark):
    from pyspark.sql import functions as F

    assert bpe_tree.encode(empty).count() == 0
    t = bpe_tree.encode(spark.createDataFrame([(1, "Hello there")], "doc_id long, text string"), decoded=True).withColumn("again", bpe_tree.decode(F.col("ids"))).first()
    assert t.text == t.again == "hello</w> there</w>"
    assert spark.createDataFrame([(None,)], "ids binary").select(bpe_tree.decode(F.col("ids")).alias("t")).first().t is None

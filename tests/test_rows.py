"""Queries that work a document out in its row: nothing of it is shuffled, and rows of one id still count as one."""

from __future__ import annotations

import pytest

from tallyframe.plans import catalogue, texts
from tallyframe.plans import views as v

#: Queries, and how many exchanges their plans may have where every id stands once.
EXCHANGES = {"caption_files": 0, "dice_agreement": 1, "chunk6": 0, "core_context_text": 1, "sentence_boundaries": 1, "overlap_windows": 1}
LONG = " ".join(f"word{i} yıl_{i}, i" for i in range(40))
DOCS = [(1, LONG), (2, "one two three\nfour five six\nfour five six"), (3, None), (4, " "), (5, "extraordinarily-longish-word " * 9), (6, LONG), (8, "ııı iii\n\n" + LONG)]


def folder(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def result(spark, name, d):
    return sorted(map(str, catalogue.queries()[name](spark, d).collect()))


@pytest.mark.parametrize("name", EXCHANGES)
def test_documents_stay_in_their_rows(spark, compare, tmp_path, name):
    d = folder(spark, tmp_path, DOCS)
    plan = catalogue.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= EXCHANGES[name] and "UDTF" not in plan
    got, wanted = compare(catalogue.queries()[name], catalogue.oracle_sql()[name], d)
    assert got == wanted


@pytest.mark.parametrize("name", [*(x for x in EXCHANGES if x != "dice_agreement"), "pairwise_jaccard"])
def test_rows_of_one_id_count_as_one_document(spark, tmp_path, monkeypatch, name):
    d = folder(spark, tmp_path, [*DOCS, (2, "one two three\nfour five six\nfour five six"), (None, "alone i"), (None, "alone i")])
    got = result(spark, name, d)
    monkeypatch.setattr(v, "by_row", lambda docs, own, shared: shared(docs))
    assert got == result(spark, name, d)


def test_lines_of_a_row_meet_there(spark, compare, tmp_path, monkeypatch):
    d = folder(spark, tmp_path, DOCS)
    near = texts.similar_lines(v.table(spark, d, "documents").where("text is not null"))
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    for most in (256, 1):  # within rows; by rare words
        monkeypatch.setattr(texts, "ROW_LINES", most)
        got, wanted = compare(texts.pairwise_jaccard, texts.SQL["pairwise_jaccard"], d)
        assert got == wanted and got


def test_terms_are_counted_once(spark, compare, tmp_path):
    rows = [*DOCS, (7, " ".join(f"t{i}" for i in range(70, 0, -1))), (2, "three two"), (None, "nobody nobody")]
    d = folder(spark, tmp_path, rows)
    assert "w" not in [f.name for f in texts.term_freq_top(spark, d).schema]
    got, wanted = compare(texts.term_freq_top, texts.SQL["term_freq_top"], d)
    assert got == wanted and len(got) == 50

"""Language identification: what the sample holds, and the mixture against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string"


def test_a_language_of_one_repeated_text_is_learned(spark):
    rows = [(i, "der schnelle braune fuchs springt", "de") for i in range(2000)] + [(5000 + i, f"the quick brown fox number {'abcdefghij'[i % 10] * (i % 7 + 1)} jumps", "en") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: r.lang_pred for r in li.language_id(df, sample=10).collect()}
    assert all(got[i] == "de" for i in range(2000)) and all(got[5000 + i] == "en" for i in range(60))


@pytest.mark.parametrize("n", [5, 40, 300])
def test_the_sample_holds_different_texts(spark, n):
    rows = [(i, f"word {'xyz'[i % 3]} {i % n}", "en") for i in range(3000)] + [(9999, None, "en"), (9998, "lost", None)]
    languages, model = li.learn(spark.createDataFrame(rows, SCHEMA), F.lit(True), sample=50)
    texts = {r[1] for r in rows if r[1] and r[2]}
    total = sum(sum(li.trigram_counts(t)[1]) for t in texts)
    taught = (1 / model[:, 0].min()) * 0.5 - 0.5 * li.TRIGRAMS  # counts come back from the smallest probability
    assert languages == ["en"] and round(taught) == (total if len(texts) <= 50 else pytest.approx(total * 50 / len(texts), rel=0.1))


def plain_counts(text):
    raw = [c for c in f" {text.lower()} ".encode()]
    b = [c if c >= 128 or 97 <= c <= 122 else 32 for c in raw]
    out = Counter()
    for x, y, z in zip(b, b[1:], b[2:], strict=False):
        if (y, z) != (32, 32):
            out[(((x << 16 | y << 8 | z) * 2654435761) % 2**32) >> 17] += 1
    return out


def plain_mixture(columns, counts):
    """Proportions by loops: columns of probabilities by cell, each scaled by the largest of its cell."""
    k, n = len(columns), sum(counts.values())
    share = [1 / k] * k
    top = {c: max(col[c] for col in columns) for c in counts}
    while k > 1:
        new = [0.0] * k
        for c, m in counts.items():
            p = [share[i] * columns[i][c] / top[c] for i in range(k)]
            for i in range(k):
                new[i] += m * p[i] / sum(p) / n
        moved = max(abs(x - y) for x, y in zip(new, share, strict=True))
        share = new
        if moved < li.SETTLED:
            break
    fit = sum(m * math.log(sum(s * col[c] / top[c] for s, col in zip(share, columns, strict=True))) for c, m in counts.items())
    return share, fit


def test_the_mixture_is_that_of_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(0)
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text and r.lang]
    rng.shuffle(rows)
    languages, model = li.learn(docs, F.lit(True))
    taught = {}
    for text, lang in {(r.text, r.lang) for r in rows}:
        taught.setdefault(lang, Counter()).update(plain_counts(text))
    assert languages == sorted(taught)
    columns = []
    for lang in languages:
        total = sum(taught[lang].values()) + 0.5 * li.TRIGRAMS
        columns.append({c: (taught[lang][c] + 0.5) / total for c in range(li.TRIGRAMS)})
    for r in rows[:12] + [type("R", (), {"text": rows[0].text[:300] + " " + rows[1].text[:300]})()]:
        counts = plain_counts(r.text)
        share, _ = plain_mixture(columns, counts)
        alone = [sum(m * math.log(col[c] / max(k[c] for k in columns)) for c, m in counts.items()) for col in columns]
        order = [max(range(len(languages)), key=lambda i: alone[i])]
        order += [i for i in sorted(range(len(languages)), key=lambda i: -share[i]) if i != order[0] and share[i] > 0.02]
        best, value = [1.0], alone[order[0]]
        for k in range(2, len(order) + 1):
            top_all = {c: max(col[c] for col in columns) for c in counts}
            chosen = [columns[i] for i in order[:k]]
            tried, fit = plain_mixture(chosen, counts)
            fit += sum(m * math.log(max(col[c] for col in chosen) / top_all[c]) for c, m in counts.items())
            if fit - value <= li.PENALTY * math.log(sum(counts.values())):
                break
            best, value = tried, fit
        want = sorted(((order[i], s) for i, s in enumerate(best)), key=lambda x: -x[1])
        got = li.infer(model, r.text)
        assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want], abs=2e-2)

"""Text signals read each text once, and their patterns count what longer ones counted."""

import random

from pyspark.sql import functions as F

from tallyframe.functions import text as tx

NUMERIC = r"(?iU)\d+(?:[.,]\d+)*\s*%?|%\s*\d+|\b(?:yüzde|bin|milyon|milyar|katı?|oran(?:ı|ında)?|lira|tl|dolar|euro|asgari)\b"
QUESTION_WORDS = r"(?iU)\b(?:ne|neden|niye|nasıl|kaç|hangi|kim|nerede|nereye|ne\s+kadar|niçin)\b"
QUESTION_CLITICS = r"(?iU)\b(?:mı|mi|mu|mü)\b|\w+(?:mı|mi|mu|mü)\b"
PIECES = [
    "mı", "mi", "mu", "mü", "MI", "Mİ", "MU", "MÜ", "m", "ı", "mımı", "amıb", "geldimi", "ne", "Ne", "NEDEN", "ne  kadar", "nasIl", "kaç", "Kim", "kim", "hangi", "nered", "bin", "BİN", "Katı", "katı", "kat", "oranında", "OranI", "euro", "tl", "5", "5,5",
    "3.000", "%", " % ", "40", "٥", " ", " ", " ", "-", "_", "'", ".", "?", "\n", "̇", "i̇", "́", "‍", "\U0001d7d8", "\U0001f600", "é", "ß", "ſ",
]


def test_patterns_count_as_the_longer_ones(spark):
    deal = random.Random(7)
    texts = [("".join(deal.choices(PIECES, k=deal.randint(0, 12))),) for _ in range(4000)] + [(x,) for x in PIECES]
    t = spark.createDataFrame(texts, "t string")
    for was, now in ((NUMERIC, tx.NUMERIC), (QUESTION_WORDS, tx.QUESTION_WORDS), (QUESTION_CLITICS, tx.QUESTION_CLITICS)):
        n = t.select("t", F.regexp_count("t", F.lit(was)).alias("was"), F.regexp_count("t", F.lit(now)).alias("now"))
        assert n.where("was <> now").collect() == []
        assert n.where("was > 0").count() > 100


def test_words_are_told_once_a_text(spark):
    rows = spark.createDataFrame([("a", 1.0, None, None)], "t string, d double, o string, p string")
    plan = tx.text_signals(rows, "t", "d", "o", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == plan.count("(?iU)") + 1  # one for each pattern that is counted, and the words
    assert r"\w+(?:m" not in plan


def test_odd_texts(spark):
    rows = spark.createDataFrame([
        (1, None, 2.0, None, None), (2, "", 0.0, "", "mi? "), (3, "  Bu o yani ŞU geldi mi? ", 2.0, "  Bu o", "olur mu?\t"), (4, "bir iki üç dört beş altı yedi sekiz bu onlar", None, None, "olur mu?x"),
        (5, "Yani bin lira", 1.0, "Yani", None), (5, "Yani bin lira", 1.0, "Yani", None),
    ], "k int, t string, d double, o string, p string")
    got = {r["k"]: r for r in tx.text_signals(rows, "t", "d", "o", "p").collect()}
    assert [(r["word_count"], [(p["rule"], p["token"]) for p in r["self_contained_penalties"]]) for r in got.values()] == [
        (0, [("empty_segment", None)]), (0, [("empty_segment", None)]),
        (6, [("opens_with_connective", "Bu"), ("unbound_pronoun_in_opening", None), ("starts_mid_answer", None)]),
        (10, []), (3, [("opens_with_connective", "Yani")]),
    ]
    assert [(r["numeric_per_100w"], r["question_per_100w"], r["speech_rate_wps"]) for r in got.values()] == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 33.33, 3.0), (0.0, 0.0, 0.0), (66.67, 0.0, 3.0)]
    assert set(got[1].asDict()) == {"k", "t", "d", "o", "p", "word_count", "numeric_per_100w", "question_per_100w", "speech_rate_wps", "numeric_score", "question_score", "rate_score", "self_contained_score", "self_contained_penalties"}

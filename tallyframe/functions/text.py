"""Text functions as column expressions, with Turkish case rules where plain ones differ."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numbers import round_binary

#: Letters with a Turkish diacritic, and the forms without.
DIACRITICS, SHADOWS = "çÇğĞıİöÖşŞüÜ", "cCgGiIoOsSuU"
#: Words that point back, pronouns among them, and abbreviations whose dot ends no sentence.
ANAPHORA = "bu o şu bunu onu şunu bunun onun şunun bunlar onlar yani ama fakat ancak dolayısıyla işte çünkü ayrıca böylece".split()
PRONOUNS = "bu o şu bunu onu bunlar onlar".split()
ABBREVIATIONS = "dr sn vb vs bkz prof doç av mah cad sok no tl örn yy".split()
#: Patterns of numbers and money, and of question words and clitics. A first letter is looked at before
#: the word boundary, which costs more; a clitic counts as a word or at a word's end, so the word before it isn't read.
NUMERIC = r"(?iU)\d+(?:[.,]\d+)*\s*%?|%\s*\d+|(?=[abdeklmoty])\b(?:yüzde|bin|milyon|milyar|katı?|oran(?:ı|ında)?|lira|tl|dolar|euro|asgari)\b"
QUESTION_WORDS = r"(?iU)(?=[hkn])\b(?:ne|neden|niye|nasıl|kaç|hangi|kim|nerede|nereye|ne\s+kadar|niçin)\b"
QUESTION_CLITICS = r"(?iU)(?:mı|mi|mu|mü)\b"
WORD = r"(?U)\w+"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composed form; Spark has no expression for it."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def tr_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def tr_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def tr_title(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(tr_upper(F.substring(w, 1, 1)), tr_lower(w.substr(F.lit(2), F.length(w))))), " ")


def ascii_fold(c: Column) -> Column:
    return F.translate(c, DIACRITICS, SHADOWS)


def diacritic_density(c: Column) -> Column:
    """Diacritics in a thousand characters; 0 for an empty text."""
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(F.regexp_replace(c, f"[^{DIACRITICS}]", "")) * 1000.0 / F.nullif(F.length(c), F.lit(0)))


def has_combining(c: Column) -> Column:
    """Whether decomposed marks are left, so that composing was missed."""
    return c.rlike("[̧̇̆̈]")


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def scale(c: Column, low: float, high: float) -> Column:
    """0 to 10 between low and high, clipped."""
    return F.lit(0.0) if high <= low else F.greatest(F.lit(0.0), F.least(F.lit(10.0), (c - low) / (high - low) * 10))


def per_hundred(hits: Column, n_words: Column) -> Column:
    return F.when(n_words == 0, 0.0).otherwise(hits * 100.0 / F.nullif(n_words, F.lit(0)))


def numeric_density(c: Column, pattern: str = NUMERIC, n_words: Column | None = None) -> Column:
    return per_hundred(F.regexp_count(c, F.lit(pattern)), n_words if n_words is not None else F.size(words(c)))


def question_density(c: Column, opening: Column | None = None, n_words: Column | None = None) -> Column:
    """Question marks, words and clitics in a hundred words; those of the opening count twice."""
    hits = lambda x: F.length(x) - F.length(F.replace(x, F.lit("?"), F.lit(""))) + F.regexp_count(x, F.lit(QUESTION_WORDS)) + F.regexp_count(x, F.lit(QUESTION_CLITICS))
    return per_hundred(hits(c) + (hits(F.coalesce(opening, F.lit(""))) if opening is not None else 0), n_words if n_words is not None else F.size(words(c)))


def rate_score(wps: Column) -> Column:
    """Highest at 3.2 words a second; none up to 2.0 or from 4.5."""
    return F.when((wps <= 2.0) | (wps >= 4.5), 0.0).when(wps <= 3.2, scale(wps, 2.0, 3.2)).otherwise(scale(4.5 - wps, 0.0, 4.5 - 3.2))


def self_contained(c: Column, previous: Column, tokens: Column | None = None) -> Column:
    """10 less 4 for a connective at the start, 3 for a pronoun soon after, 3 after a question; 0 without words."""
    t = F.transform(tokens if tokens is not None else words(F.trim(c)), tr_lower)
    opens = F.get(t, F.lit(0)).isin(*ANAPHORA)
    bare = F.exists(F.slice(t, 2, 7), lambda w: w.isin(*PRONOUNS))
    mid = F.coalesce(F.rtrim(previous).endswith("?"), F.lit(False))
    return F.when(F.size(t) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(10.0) - F.when(opens, 4.0).otherwise(0.0) - F.when(bare, 3.0).otherwise(0.0) - F.when(mid, 3.0).otherwise(0.0)))


#: What the rules of a stand-alone opening take off.
CONNECTIVE, UNBOUND, MID_ANSWER, NO_WORDS = ("opens_with_connective", -4.0), ("unbound_pronoun_in_opening", -3.0), ("starts_mid_answer", -3.0), ("empty_segment", -10.0)


def opening_words(tokens: Column) -> Column:
    """The words that the rules of a stand-alone opening look at."""
    return F.slice(tokens, 1, 8)


def penalties(c: Column, previous: Column, raw: Column | None = None, low: Column | None = None) -> Column:
    """What takes a text off 10 as an opening that stands alone: array of (rule, token, delta), in order of
    the rules; token is the word that opens with a connective. A text without words has only that rule.
    raw and low are its opening words, as they are and in lower case, where they are there already."""
    raw = raw if raw is not None else opening_words(words(F.trim(c)))
    t = low if low is not None else F.transform(raw, tr_lower)

    def rule(found: Column, name: tuple[str, float], token: Column | None = None) -> Column:
        return F.when(found, F.struct(F.lit(name[0]).alias("rule"), (token if token is not None else F.lit(None).cast("string")).alias("token"), F.lit(name[1]).alias("delta")))

    some = F.array(
        rule(F.get(t, F.lit(0)).isin(*ANAPHORA), CONNECTIVE, F.get(raw, F.lit(0))), rule(F.exists(F.slice(t, 2, 7), lambda w: w.isin(*PRONOUNS)), UNBOUND),
        rule(F.coalesce(F.regexp_replace(previous, r"\s+$", "").endswith("?"), F.lit(False)), MID_ANSWER),
    )
    return F.when(F.size(t) == 0, F.array(rule(F.lit(True), NO_WORDS))).otherwise(F.filter(some, lambda x: x.isNotNull()))


def text_signals(rows: DataFrame, text: str, duration: str, opening: str, previous: str) -> DataFrame:
    """rows with word_count, numeric_per_100w, question_per_100w, speech_rate_wps, numeric_score, question_score,
    rate_score, self_contained_score and self_contained_penalties of a segment's text.

    opening is what is said in its first seconds, previous the segment before; null for none. A null text
    counts as empty; without a duration the rate is 0. Steps are columns of their own, so each pattern
    runs once a row, and the rules of the opening see its first words only.
    """
    t, n = F.col("_t"), F.col("word_count")
    r = rows.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", words(t))
    r = r.withColumns({"word_count": F.size("_words"), "_raw": opening_words(F.col("_words"))}).withColumn("_low", F.transform("_raw", tr_lower))
    r = r.withColumns({"_numeric": numeric_density(t, n_words=n), "_question": question_density(t, F.col(opening), n), "self_contained_penalties": penalties(t, F.col(previous), F.col("_raw"), F.col("_low"))})
    r = r.withColumn("_wps", F.when(F.col(duration) > 0, F.col("word_count") / F.col(duration)).otherwise(0.0))
    off = F.aggregate("self_contained_penalties", F.lit(0.0), lambda a, x: a + x["delta"])
    two = {
        "numeric_per_100w": F.col("_numeric"), "question_per_100w": F.col("_question"), "speech_rate_wps": F.col("_wps"), "numeric_score": scale(F.col("_numeric"), 0.0, 6.0), "question_score": scale(F.col("_question"), 0.0, 5.0),
        "rate_score": rate_score(F.col("_wps")), "self_contained_score": F.greatest(F.lit(0.0), 10.0 + off),
    }
    return r.withColumns(two).withColumns({k: round_binary(F.col(k), 2) for k in two}).drop("_t", "_words", "_raw", "_low", "_numeric", "_question", "_wps")


def is_abbreviation(token: Column) -> Column:
    """Whether a token's final dot ends no sentence: ordinals and listed abbreviations."""
    body = F.regexp_replace(token, "[.?!…]+$", "")
    return F.coalesce((body != "") & (body.rlike(r"^\d+$") | tr_lower(body).isin(*ABBREVIATIONS)), F.lit(False))


def norm_ws(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def urls_as_23(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+", "x" * 23)


def grams(tokens: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens: the array zipped with itself shifted, so it is evaluated n times and not once a run."""
    m = F.greatest(F.lit(0), F.size(tokens) - n + 1)
    runs = F.slice(tokens, F.lit(1), m)
    for j in range(2, n + 1):
        runs = F.zip_with(runs, F.slice(tokens, F.lit(j), m), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(runs)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def recall(wanted: Column, found: Column) -> Column:
    w = F.array_distinct(wanted)
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_intersect(w, found)) / F.nullif(F.size(w), F.lit(0)))


#: Turkish number words without diacritics.
NUMBER_WORDS = {
    "sifir": 0, "bir": 1, "iki": 2, "uc": 3, "dort": 4, "bes": 5, "alti": 6, "yedi": 7, "sekiz": 8, "dokuz": 9, "on": 10,
    "yirmi": 20, "otuz": 30, "kirk": 40, "elli": 50, "altmis": 60, "yetmis": 70, "seksen": 80, "doksan": 90, "yuz": 100, "bin": 1000,
    "milyon": 1000000, "milyar": 1000000000,
}


def spelled_numbers(c: Column) -> Column:
    """Distinct numbers that a text spells, alone and as compounds, in order of value: a number word
    may carry a suffix of up to three letters; words from 100 on multiply what stands before them."""
    tokens = words(ascii_fold(tr_lower(c)))
    exact = F.create_map(*(F.lit(x) for k, n in NUMBER_WORDS.items() for x in (k, n)))
    stems = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in NUMBER_WORDS.items()))

    begins = "^(?:" + "|".join(NUMBER_WORDS) + ")"  # most words begin like none: they are told by one pattern

    def value(t: Column) -> Column:
        near = F.filter(stems, lambda s: t.startswith(s["k"]) & F.length(t).between(F.length(s["k"]) + 1, F.length(s["k"]) + 3))
        return F.when(t.rlike(begins), F.coalesce(F.try_element_at(exact, t), F.get(near, F.lit(0))["n"])).cast("long")

    start = F.struct(F.lit(0).cast("long").alias("run"), F.array().cast("array<bigint>").alias("found"))

    def step(acc: Column, n: Column) -> Column:
        ended = F.when(acc["run"] > 0, F.array_append(acc["found"], acc["run"])).otherwise(acc["found"])
        grown = F.when((n >= 100) & (acc["run"] > 0), acc["run"] * n).otherwise(acc["run"] + n)
        return F.struct(F.when(n.isNull(), F.lit(0).cast("long")).otherwise(grown).alias("run"), F.when(n.isNull(), ended).otherwise(F.array_append(acc["found"], n)).alias("found"))

    return F.aggregate(F.transform(tokens, value), start, step, lambda acc: F.array_sort(F.array_distinct(F.when(acc["run"] > 0, F.array_append(acc["found"], acc["run"])).otherwise(acc["found"]))))

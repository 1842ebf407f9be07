"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed byte trigrams. A document is a mixture of languages:
expectation-maximisation estimates its proportions from the trigrams' likelihoods, and the set of
languages grows while the likelihood, less half a log of the trigram count for each added language,
improves. The prediction is the language with the largest share.

Fitting takes at most SAMPLE different labelled texts of a language, those of the smallest hashes
over the whole table; the model has TRIGRAMS cells for each language and is what is broadcast.

Defined cases: null text, or text without a letter, is `und` with score 0; rows without lang or text
teach nothing; with no labelled rows at all every prediction is `und`; null ids are kept; repeated
rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, stored

TRIGRAMS, SAMPLE, MAX_LANGUAGES = 1 << 15, 4000, 256
PENALTY = 0.5
#: Expectation-maximisation goes on until no share changes by so much.
SETTLED = 1e-3
_fold = np.arange(256, dtype=np.uint32)
_fold[:128] = 32
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of the text's byte trigrams; ASCII other than letters counts as a blank."""
    b = _fold[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[(code & 0xFFFF) != 0x2020]
    counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(17), minlength=TRIGRAMS)
    cells = counts.nonzero()[0]
    return cells, counts[cells].astype(float)


def mixture(likelihood: np.ndarray, counts: np.ndarray, settled: float = SETTLED) -> tuple[np.ndarray, float]:
    """Proportions of the columns, and the log likelihood, by expectation-maximisation."""
    k, n = likelihood.shape[1], counts.sum()
    share = np.full(k, 1 / k)
    while k > 1:
        p = likelihood * share
        before, share = share, (counts / p.sum(1)) @ p / n
        if np.abs(share - before).max() < settled:
            break
    return share, float(counts @ np.log(likelihood @ share))


def infer(model: np.ndarray, text: str, penalty: float = PENALTY) -> list[tuple[int, float]]:
    """(language, proportion) pairs of the chosen set, the largest first."""
    cells, counts = trigram_counts(text)
    if not len(cells):
        return []
    likelihood = model[cells]
    likelihood = likelihood / likelihood.max(1, keepdims=True)
    share, _ = mixture(likelihood, counts)
    alone = counts @ np.log(likelihood)
    order = [int(alone.argmax())]
    order += [int(i) for i in np.argsort(-share, kind="stable") if i != order[0] and share[i] > 0.02]
    best, value = np.ones(1), float(alone[order[0]])
    for k in range(2, len(order) + 1):
        tried, fit = mixture(likelihood[:, order[:k]], counts)
        if fit - value <= penalty * np.log(counts.sum()):
            break
        best, value = tried, fit
    return sorted(((order[i], float(s)) for i, s in enumerate(best)), key=lambda x: -x[1])


def _teach(batches):
    sums: dict[str, np.ndarray] = {}
    for t in batches:
        for lang, text in zip(t.column("lang").to_pylist(), t.column("text").to_pylist(), strict=True):
            cells, counts = trigram_counts(text)
            sums.setdefault(lang, np.zeros(TRIGRAMS))[cells] += counts
    for lang, a in sums.items():
        cells = a.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(a[cells])], names=["lang", "cell", "n"])


def learn(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities by cell and language) from the usable labelled rows."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    marked = rows.withColumn("h", F.xxhash64("text")).withColumn("part", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1 << 30)) / (1 << 30))
    totals = {r["lang"]: r["n"] for r in marked.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return [], np.ones((TRIGRAMS, 0))
    # the smallest hashes of different texts: a threshold that about three times as many pass, raised
    # for a language of which fewer than the sample have passed, then exact ranks among these
    low = {lang: min(1.0, 3 * sample / max(1, n)) for lang, n in totals.items()}
    while True:
        limits = F.create_map(*(F.lit(x) for kv in low.items() for x in kv))
        few = stored(marked.where(F.col("part") < limits[F.col("lang")]).groupBy("lang", "h").agg(F.min("part").alias("part")))
        counts = {r["lang"]: r["n"] for r in few.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        short = [lang for lang in low if counts.get(lang, 0) < sample and low[lang] < 1]
        if not short:
            break
        low |= {lang: min(1.0, 4 * low[lang]) for lang in short}
    passed = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("part", "h")))
    picked = passed.where(F.col("nth") <= sample).select("lang", "h")  # at most `sample` rows a language
    chosen = marked.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    cells = chosen.select("lang", "text").mapInArrow(_teach, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(totals)
    model = np.full((TRIGRAMS, len(languages)), 0.5)
    for i, lang in enumerate(languages):
        own = cells[cells.lang == lang]
        model[own.cell.to_numpy(), i] += own.n.to_numpy()
    return languages, model / model.sum(0)


def identify(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """The rows' columns doc_id and held_out with lang_pred, score and languages (shares as text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        for t in batches:
            out: list[tuple] = []
            for text in t.column("text").to_pylist():
                found = infer(sent.value, text) if languages and text is not None and letter.search(text) else []
                out.append((languages[found[0][0]], found[0][1], ",".join(f"{languages[i]}:{s:.4f}" for i, s in found)) if found else ("und", 0.0, ""))
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id"), t.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([min(1.0, x[1]) for x in out], pa.float64()), pa.array([x[2] for x in out], pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def language_id(docs: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: a row per document, learned from the other folds."""
    held = crc_mod(F.col("doc_id"), folds) == fold
    languages, model = learn(docs, ~held, sample)
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), languages, model)


def named(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """The rows, with all their columns, whose prediction is not `und`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        for t in batches:
            keep = [bool(languages and text is not None and letter.search(text) and infer(sent.value, text)) for text in t.column("text").to_pylist()]
            yield t.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Packing documents into sequences: cutting-stock by column generation.

Each document is tokenised whole and cut into full sequences and one remainder. The remainders'
length histogram (a bounded number of length classes) is the demand of a cutting-stock linear
program over filling patterns; a knapsack dynamic program prices new patterns until none improves
it. Patterns are rounded down, what they leave is packed first-fit decreasing, and the patterns'
places are dealt to the pieces by their rank within their class. With an order of the documents,
each pattern's sequences are spread over it, classes are ranked by it, and sequences are numbered
by the mean position of their pieces.

Defined cases: a null text counts as empty and has only the closing id; a null doc_id is kept;
repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Shares of a pattern's sequences that are spread over an order of the documents, and positions in a bucket of it.
SLICES, BUCKET = 16, 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Tokens in a length class: a piece takes its length rounded up to a multiple of it.
UNIT = 8
#: How far the program may stay above the bound by the lengths' sum.
GAP = 1e-3
#: Parts and words whose ids a worker remembers; of twice as many the older half goes.
REMEMBERED = 250_000
#: The tokenizer's own word pattern and steps, and letters for which its normaliser is lower().
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
PLAIN = r"[!-~\u00a1-\u012f\u0131-\u024f]*"
_state: dict = {}


class _Recent(dict):
    """Answers by key, computed when missing; two generations of bounded size."""

    def __init__(self, compute):
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def _known(name: str):
    """Part without blanks -> its ids' bytes, by the tokenizer of that name or path; for a tokenizer
    of other steps than STEPS a function of whole texts."""
    if name not in _state:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if any(spec.get(k) != v for k, v in STEPS.items()) or spec["model"]["type"] != "BPE":  # another tokenizer: whole texts, by itself
            _state[name] = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            return _state[name]
        model, words, plain = tokenizer.model, regex.compile(WORDS), regex.compile(PLAIN)

        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

        def word(w):
            return array("I", [t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]).tobytes()

        def part(p):
            if "<|" in p or not (p.isprintable() if p.isascii() else plain.fullmatch(p)):
                return array("I", tokenizer.encode(p, add_special_tokens=False).ids).tobytes()
            if p.isascii() and p.isalpha() and p.islower():
                return word(p)
            found = words.findall(p.lower())
            return word(p) if found == [p] else b"".join([known[w] for w in found])

        known = _Recent(part)
        _state[name] = known
    return _state[name]


def stretch_ids(name: str):
    """Stretch without blanks -> its ids' bytes, remembered; None for a tokenizer of other steps than STEPS."""
    known = _known(name)
    return known if isinstance(known, _Recent) else None


def token_bytes(texts: list[str], name: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    parts between blanks and line ends; a part of plain Latin text is that of its words.
    """
    known = _known(name)
    if not isinstance(known, _Recent):
        return [known(text) for text in texts]
    return [b"".join([known[p] for p in text.replace("\n", " ").split(" ")]) for text in texts]


def _cut(name: str, size: int, closing: int):
    last = np.array([closing], "<u4").tobytes()

    def run(batches):
        for t in batches:
            ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
            more = t.column("text_hash").to_pylist() if "text_hash" in t.schema.names else None
            rows = []
            for k, (doc_id, data) in enumerate(zip(ids, token_bytes(texts, name), strict=True)):
                data += last
                n = len(data) // 4
                rows += [(doc_id, s, min(size, n - s), zlib.crc32(data[4 * s : 4 * (s + size)]), n, more and more[k]) for s in range(0, n, size)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["text_hash"] if more is not None else [])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, size: int, closing: int, hashed: bool = False) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.xxhash64("text").alias("text_hash")] if hashed else []))
    return texts.mapInArrow(_cut(tokenizer, size, closing), PIECES + (", text_hash long" if hashed else ""))


def filled(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack over lengths 1..capacity with these values (index 0 unused): for each room the best value and the length it takes last."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        sums = values[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(sums.argmax())
        best[c], pick[c] = (sums[k], k + 1) if sums[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    return best, pick


def unrolled(pick: np.ndarray, room: int) -> dict[int, int]:
    pattern: dict[int, int] = {}
    while room > 0:
        if s := int(pick[room]):
            pattern[s] = pattern.get(s, 0) + 1
            room -= s
        else:
            room -= 1
    return pattern


def patterns_through(values: np.ndarray, sizes: np.ndarray, capacity: int, most: int) -> tuple[float, list[dict[int, int]]]:
    """The knapsack's best value, and the best patterns that hold a given length, of the `most` lengths of the largest such values."""
    best, pick = filled(values, capacity)
    through = values[sizes] + best[capacity - sizes]
    found = {}
    for k in np.argsort(-through, kind="stable")[:most].tolist():
        pattern = unrolled(pick, capacity - int(sizes[k]))
        pattern[int(sizes[k])] = pattern.get(int(sizes[k]), 0) + 1
        found[tuple(sorted(pattern.items()))] = pattern
    return float(best[capacity]), list(found.values())


def solve(demand: dict[int, int], capacity: int, gap: float = GAP, pivots: int = 200_000) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) with how often each is used, covering the demand.

    The simplex method on the covering program; one knapsack table prices a column through every
    length. It ends at the optimum, or within `gap` of the bound that the lengths' sum gives. Runs on
    the driver: its size is the number of length classes, whatever the input's size.
    """
    sizes = sorted(k for k, v in demand.items() if v > 0)
    if not sizes:
        return []
    m, lengths = len(sizes), np.array(sizes)
    row = {s: i for i, s in enumerate(sizes)}
    need = np.array([demand[s] for s in sizes], float)
    columns: list[dict[int, int] | None] = [{s: capacity // s} for s in sizes]
    cost, inverse = np.ones(m), np.diag([1.0 / (capacity // s) for s in sizes])
    x, dual, done = inverse @ need, None, 0
    enough = float(lengths @ need) / capacity * (1 + gap)
    while True:
        dual = cost @ inverse
        if (low := int(dual.argmin())) >= 0 and dual[low] < -1e-9:  # a surplus column enters
            entering = [None]
        else:
            values = np.full(capacity + 1, -1.0)
            values[sizes] = dual
            best, entering = patterns_through(values, lengths, capacity, 64)
            if best <= 1 + 1e-7 or float(x @ cost) <= enough:
                break
        for pattern in entering:
            if pattern is None:
                step, gain, c = -inverse[:, low], -dual[low], 0.0
            else:
                at, copies = [row[s] for s in pattern], np.array(list(pattern.values()), float)
                step, gain, c = inverse[:, at] @ copies, float(dual[at] @ copies) - 1, 1.0
            up = step > 1e-10
            if gain <= 1e-9 or not up.any():
                continue
            ratio = np.full(m, np.inf)
            ratio[up] = np.maximum(x[up], 0) / step[up]
            out = int(ratio.argmin())
            x = x - ratio[out] * step
            x[out] = ratio[out]
            pivot = inverse[out] / step[out]
            some = step.nonzero()[0]
            inverse[some] -= np.outer(step[some], pivot)
            inverse[out] = pivot
            columns[out], cost[out], dual, done = pattern, c, dual - gain * pivot, done + 1
            if done > pivots:
                raise RuntimeError(f"the packing program isn't solved after {pivots} pivots")
    left = dict(demand)
    used: list[tuple[dict[int, int], int]] = []
    for pattern, amount in sorted(((p, v) for p, v in zip(columns, x.tolist(), strict=True) if p), key=lambda q: -q[1]):
        n = min([int(amount + 1e-9), *(left[s] // k for s, k in pattern.items())])
        if n > 0:
            used.append((pattern, n))
            for s, k in pattern.items():
                left[s] -= n * k
    while any(left.values()):  # first-fit decreasing by classes; a pattern repeats as often as it fits
        room, pattern = capacity, {}
        for s in sorted((s for s, n in left.items() if n > 0), reverse=True):
            if k := min(left[s], room // s):
                pattern[s] = k
                room -= k * s
        n = min(left[s] // k for s, k in pattern.items())
        used.append((pattern, n))
        for s, k in pattern.items():
            left[s] -= n * k
    return used


def places_of(patterns: list[tuple[dict[int, int], int]], slices: int) -> list[tuple[int, int, int, int, int]]:
    """(class, rank_from, rank_to, sequence_from, copies): the ranks of each class in order of the slices of each pattern."""
    places, sequence, taken = [], 0, {}
    for i in range(slices):
        for pattern, whole in patterns:
            n = (2 * whole * (i + 1) + slices) // (2 * slices) - (2 * whole * i + slices) // (2 * slices) if slices > 1 else whole
            for s, k in pattern.items() if n else ():
                at = taken.get(s, 0)
                places.append((s, at, at + n * k, sequence, k))
                taken[s] = at + n * k
            sequence += n
    return places


def numbered(placed: DataFrame) -> DataFrame:
    """The rows with sequences numbered by the mean position of their pieces."""
    placed = stored(placed)
    means = placed.groupBy("sequence_id").agg(F.avg("position").alias("mean")).withColumn("bucket", F.floor(F.col("mean") / BUCKET))
    counts = means.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select(F.col("bucket").alias("b_bucket"), (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("mean", "sequence_id")) - 1
    new = means.withColumn("nth", nth).join(before, F.col("bucket") == F.col("b_bucket")).select(F.col("sequence_id").alias("s_id"), (F.col("before") + F.col("nth")).alias("number"))
    return placed.join(new, F.col("sequence_id") == F.col("s_id")).drop("sequence_id", "s_id").withColumnRenamed("number", "sequence_id")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = 2048, closing: int = 1, unit: int = UNIT, order: DataFrame | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece.

    Ranks within a class are counted in buckets of it, by hash or by position, and shifted by the
    buckets' counts, so no class, however common, is ranked in one task. The broadcast table of
    places has a row for each class in each pattern: at most size/unit squared, whatever the
    input's size, and with an order (doc_id, text_hash, position: each document once) SLICES times that.
    """
    spark = docs.sparkSession
    cut = token_pieces(docs, tokenizer, size, closing, order is not None)
    if order is not None:
        at = order.select(F.col("doc_id").cast("long").alias("o_id"), F.col("text_hash").alias("o_hash"), "position")
        cut = stored(cut).join(at, (F.col("text_hash") == F.col("o_hash")) & F.col("doc_id").eqNullSafe(F.col("o_id"))).drop("o_id", "o_hash", "text_hash")
    pieces = stored(cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int")))
    demand = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    total = sum(demand.values())
    places = places_of(solve(demand, size // unit), 1 if order is None else SLICES)
    table = spark.createDataFrame(places, "p_class int, rank_from long, rank_to long, sequence_from long, copies long")
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    first = [] if order is None else ["position"]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)) if order is None else F.floor(F.col("position") / BUCKET))
    counts = dealt.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = counts.select(F.col("class").alias("b_class"), F.col("bucket").alias("b_bucket"), (F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("before"))
    within = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(*first, "doc_id", "start", "ids_crc32")) - 1)
    ranked = within.join(before, (F.col("class") == F.col("b_class")) & (F.col("bucket") == F.col("b_bucket"))).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("p_class")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    placed = placed.withColumn("sequence_id", F.col("sequence_from") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("copies")))
    if order is not None:
        placed = numbered(placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "rank", "position"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("long")).alias("offset"))

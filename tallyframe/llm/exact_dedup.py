"""Exact deduplication by composable polynomial fingerprints.

A text's bytes, without ASCII white space, are the coefficients of a polynomial that is evaluated
at two fixed points modulo two 31-bit primes. A chunk's value moves in front of a following chunk
by one multiplication, H(ab) = H(a) * B^|b| + H(b), so the chunks of a huge text are hashed as
separate rows in parallel and combined afterwards. Rows with equal fingerprints are compared with
their group's chosen row, chunk by chunk, in a sorted join; rows that turn out to differ form a
group of their own in another pass, so a collision never merges two texts.

Defined cases: a null text counts as empty, and all empty texts are one group. A null doc_id is
kept and loses ties. Repeated rows each count and each give a row. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, TEXTS, join_by_key, stored

PRIMES = (2147483647, 2147483629)
POINTS = (1000003, 1299709)
#: Characters in a chunk; texts of more than one chunk take the row-per-chunk way.
CHUNK = 65536
#: Members of a group that are compared beside one copy of its chosen text.
BESIDE = 1000
KEY = ["fp1", "fp2", "n_bytes", "part"]
FP = "doc_id long, xx long, n_cp long, n_bytes long, fp1 long, fp2 long, text_sha256 string"
_powers: dict = {}


def chunk_hash(data: bytes, prime: int, point: int) -> int:
    """The polynomial of the bytes at the point, modulo the prime; all in 64-bit integers."""
    block = 4096  # 4096 products below 2^39 sum to less than 2^52
    if (prime, point) not in _powers:
        p, x = np.empty(block, np.int64), 1
        for i in range(block - 1, -1, -1):
            p[i], x = x, x * point % prime
        _powers[prime, point] = p
    powers, h = _powers[prime, point], 0
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    full = len(a) // block * block
    for v in (a[:full].reshape(-1, block) @ powers % prime).tolist():
        h = (h * pow(point, block, prime) + v) % prime
    if rest := len(a) - full:
        h = (h * pow(point, rest, prime) + int(a[full:] @ powers[block - rest :])) % prime
    return h


def combine(left: tuple, right: tuple, primes=PRIMES, points=POINTS) -> tuple:
    """(n_bytes, fp1, fp2) of two texts -> of their concatenation."""
    n = right[0]
    return (left[0] + n, *((a * pow(x, n, p) + b) % p for a, b, p, x in zip(left[1:], right[1:], primes, points, strict=True)))


_SPACE = ASCII_SPACE.encode()


def _whole(primes):
    def run(batches):
        for t in batches:
            out = [[] for _ in range(7)]
            for doc_id, xx, text in zip(t.column("doc_id").to_pylist(), t.column("xx").to_pylist(), t.column("text").to_pylist(), strict=True):
                data = text.encode().translate(None, _SPACE)
                row = (doc_id, xx, len(text), len(data), *(chunk_hash(data, p, x) for p, x in zip(primes, POINTS, strict=True)), hashlib.sha256(data).hexdigest())
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.string())], names=["doc_id", "xx", "n_cp", "n_bytes", "fp1", "fp2", "text_sha256"])

    return run


def _pieces(primes):
    def run(batches):
        for t in batches:
            rows = [(len(data := x.encode()), *(chunk_hash(data, p, y) for p, y in zip(primes, POINTS, strict=True))) for x in t.column("piece").to_pylist()]
            kept = [t.column(c) for c in ("doc_id", "xx", "n_cp", "text_sha256", "at")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=["doc_id", "xx", "n_cp", "text_sha256", "at", "n_bytes", "fp1", "fp2"])

    return run


def _joined(primes):
    def run(pdf):
        pdf = pdf.sort_values("at")
        total = (0, 0, 0)
        for row in zip(pdf.n_bytes.tolist(), pdf.fp1.tolist(), pdf.fp2.tolist(), strict=True):
            total = combine(total, row, primes)
        return pdf.head(1).assign(n_bytes=total[0], fp1=total[1], fp2=total[2])[["doc_id", "xx", "n_cp", "n_bytes", "fp1", "fp2", "text_sha256", "n"]]

    return run


def fingerprints(docs: DataFrame, chunk: int = CHUNK, primes=PRIMES) -> DataFrame:
    """A row per document: doc_id, xx (hash that tells rows with one id apart), n_cp (code points of
    the text), n_bytes (of the normalised text), fp1, fp2, text_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("xx", F.xxhash64("text"))
    small = texts.where(F.length("text") <= chunk).mapInArrow(_whole(primes), FP)
    bare = F.translate("text", ASCII_SPACE, "")
    huge = texts.where(F.length("text") > chunk).select("doc_id", "xx", F.length("text").cast("long").alias("n_cp"), bare.alias("bare"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("bare") - 1, F.lit(0)) / chunk).cast("int")), lambda i: F.substring(F.col("bare"), i * chunk + 1, F.lit(chunk)))
    chunks = huge.select("doc_id", "xx", "n_cp", F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"), F.posexplode(cut).alias("at", "piece"))
    hashed = chunks.mapInArrow(_pieces(primes), "doc_id long, xx long, n_cp long, text_sha256 string, at int, n_bytes long, fp1 long, fp2 long")
    # repeated rows give the same chunks: one of each, and how many
    one = hashed.groupBy("doc_id", "xx", "n_cp", "text_sha256", "at").agg(F.first("n_bytes").alias("n_bytes"), F.first("fp1").alias("fp1"), F.first("fp2").alias("fp2"), F.count("*").alias("n"))
    whole = one.groupBy("doc_id", "xx").applyInPandas(_joined(primes), FP + ", n long")
    return small.unionByName(whole.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"))


def _differing(docs: DataFrame, rows: DataFrame, groups: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, xx) of rows whose normalised text is not that of their group's chosen row."""
    many = groups.where("group_size > 1").select(*KEY, "group_size", F.xxhash64(*KEY, "keep_id", "keep_xx").alias("g"), F.ceil(F.col("group_size") / BESIDE).alias("salts"), "keep_id", "keep_xx")
    chosen = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("xx") == F.col("keep_xx"))
    members = join_by_key(rows, many, KEY, "group_size").where("g is not null").select("doc_id", "xx", "g", "salts", chosen.alias("chosen")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("xx", F.xxhash64("text"))
    m = members.select(F.col("doc_id").alias("m_id"), F.col("xx").alias("m_xx"), "g", "salts", "chosen")
    found = texts.join(m, (F.col("xx") == F.col("m_xx")) & F.col("doc_id").eqNullSafe(F.col("m_id"))).select("doc_id", "xx", "g", "salts", "chosen", F.translate("text", ASCII_SPACE, "").alias("bare"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("bare") - 1, F.lit(0)) / chunk).cast("int")), lambda i: F.substring(F.col("bare"), i * chunk + 1, F.lit(chunk)))
    chunks = found.select("doc_id", "xx", "g", "salts", "chosen", F.posexplode(cut).alias("at", "piece"))
    chosen = chunks.where("chosen").select(F.col("g").alias("c_g"), F.col("at").alias("c_at"), "salts", F.col("piece").alias("c_piece")).dropDuplicates(["c_g", "c_at"])
    chosen = chosen.withColumn("c_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    others = chunks.where("not chosen").withColumn("salt", F.pmod(F.xxhash64("doc_id", "xx"), F.col("salts")))
    beside = others.join(chosen, (F.col("g") == F.col("c_g")) & (F.col("at") == F.col("c_at")) & (F.col("salt") == F.col("c_salt")), "left")
    return beside.groupBy("doc_id", "xx").agg(F.bool_and(F.coalesce(F.col("piece") == F.col("c_piece"), F.lit(False))).alias("same")).where("not same").select("doc_id", "xx")


def exact_dedup(docs: DataFrame, chunk: int = CHUNK, primes=PRIMES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per input row.

    Of equal texts the row with the most code points, then the smallest doc_id, stays.
    Grouping is an aggregate that combines before its shuffle; a hot group's rows take its result by
    broadcast. The texts that share a fingerprint move once by id and once by group, a large group's
    dealt over one copy of its chosen text for each BESIDE members.
    """
    rows, part = stored(fingerprints(docs, chunk, primes).withColumn("part", F.lit(0)), TEXTS), 0
    while True:
        best = F.min_by(F.struct("doc_id", "xx"), F.struct(-F.col("n_cp"), F.col("doc_id").isNull(), "doc_id", "xx"))
        groups = stored(rows.groupBy(*KEY).agg(F.count("*").alias("group_size"), best.alias("best")).select(*KEY, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.xx").alias("keep_xx")))
        bad = stored(_differing(docs, rows.where(F.col("part") == part), groups.where(F.col("part") == part), chunk))
        if bad.isEmpty():
            break
        b = bad.select(F.col("doc_id").alias("b_id"), F.col("xx").alias("b_xx"))
        rows = stored(rows.join(b, (F.col("xx") == F.col("b_xx")) & F.col("doc_id").eqNullSafe(F.col("b_id")), "left").withColumn("part", F.when(F.col("b_xx").isNotNull(), part + 1).otherwise(F.col("part"))).drop("b_id", "b_xx"))
        part += 1
    out = join_by_key(rows, groups, KEY, "group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("xx") == F.col("keep_xx"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_bytes", "xx")

"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents. run() stores each stage's rows before the next reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, language_id, minhash, mixing, packing
from tallyframe.llm.common import crc_mod, drop_stored, small_batches, stored


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the mixture model can name.

    A null text and a text without any letter go, and where no row has a language all go. Null ids,
    repeated rows, very long texts and other columns, whatever their names, stay as they are. The
    session's setting for batches stays small, since the rows are worked out when they are written.
    """
    small_batches(spark)
    languages, model = language_id.learn(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return language_id.named(docs, languages, model)


def without(docs: DataFrame, found: DataFrame, hashed: str, named_only: bool = False) -> DataFrame:
    """docs less the rows that an operator (doc_id, kept and the hash of the text, null as empty) does
    not keep. Rows are told apart by id and text, so a text that stays is never lost with another of
    its id; of repeated rows with the same id and text one stays, with named_only where the id isn't null:
    that whose other columns come first as JSON text, so that no run differs from another."""
    gone = found.where("not kept").select(F.col("doc_id").alias("g_id"), F.col(hashed).alias("g_hash")).distinct()
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    left = docs.join(gone, (text == gone["g_hash"]) & docs["doc_id"].cast("long").eqNullSafe(gone["g_id"]), "left_anti")
    single = F.col("doc_id").isNotNull() if named_only else F.lit(True)
    repeated = found.where(F.col("kept") & single).groupBy("doc_id", hashed).agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return left
    rest = F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("_"))
    first = left.where(single).groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("r")).select("doc_id", "text", *(F.col("r")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")))
    return left.where(~single).unionByName(first.select(*docs.columns))


def exact_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: the longest, then of the smallest id.

    Null and empty texts are one group. A row with a null id takes part like any other: the longest
    text stays, and of equally long ones a row with an id before one without. An empty table gives no
    rows; other columns are carried along.
    """
    return without(docs, exact_dedup.exact_dedup(docs), "xx")


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that of the smallest id.

    Null and empty texts and rows with a null id are near to nothing and stay. An empty table gives
    no rows; other columns are carried along.
    """
    return without(docs, minhash.minhash_dedup(docs), "text_hash", named_only=True)


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, position: each document's place in the sources' schedule; repeated rows share the first."""
    return mixing.schedule(docs).groupBy("doc_id", "text_hash").agg(F.min("position").alias("position"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the sources' schedule: every row, none twice.

    A null source is a source of its own; a null text or id is placed like any other. An empty table
    gives no rows; other columns are carried along.
    """
    placed = positions(docs).select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), F.col("position").alias("p_position"))
    joined = docs.join(placed, (F.xxhash64(docs["text"]) == placed["p_hash"]) & docs["doc_id"].eqNullSafe(placed["p_id"]))
    order = placed["p_position"]
    return joined.repartitionByRange(order).sortWithinPartitions(order).select(*(docs[c] for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in one piece of a sequence: sequences are numbered in the order of
    the sources' schedule, which stored rows do not keep, so it is found again.

    A null text has its closing token only; null ids and repeated rows are packed as they are; an
    empty table gives no rows; other columns are left out. Batches stay small as in the first stage.
    """
    small_batches(spark)
    return packing.pack(docs, order=positions(docs))


STAGES = [("language_id", identified), ("exact_dedup", exact_unique), ("minhash_dedup", near_unique), ("mixing", mixed), ("packing", packed)]
#: Language identification and the packing program have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            drop_stored(before)  # its successor is written, so nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

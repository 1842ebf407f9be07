"""Reading artifacts: JSON documents, append logs, captions, audio, rule tables and tables that may be absent."""

from __future__ import annotations

import io
import json
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .schemas import TABLES, TRANSCRIPT


def json_documents(spark: SparkSession, path: str, schema: str = TRANSCRIPT) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """By the path's own file system, so that any store Spark reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: The file that names a store table's version.
POINTER = "CURRENT"


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that a store table's pointer names; None for a table that was never written."""
    fs, p = _store(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def switch_pointer(spark: SparkSession, path: str, version: str) -> None:
    """The pointer names another version, by a rename over the old pointer: readers see one or the other."""
    fs, new = _store(spark, f"{path}/.{POINTER}.{version}")
    out = fs.create(new, True)
    out.write(version.encode())
    out.close()
    jvm = spark._jvm
    over = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, _store(spark, f"{path}/{POINTER}")[1], over)


def drop_versions(spark: SparkSession, path: str, keep: set[str | None]) -> None:
    fs, p = _store(spark, path)
    for x in fs.listStatus(p):
        if x.isDirectory() and x.getPath().getName().startswith("v-") and x.getPath().getName() not in keep:
            fs.delete(x.getPath(), True)


def maybe_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A store table's current version, or no rows of its schema where it was never written."""
    version = current_version(spark, path)
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{version}") if version else spark.createDataFrame([], TABLES[name])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of append logs: blank lines are skipped, and each file ends at its first malformed line.

    Files are read in splittable blocks, whose lines have ids that grow within a block; the first bad
    line of each file, if it has any, is a small row by block start and id that is joined back."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    read = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("bad", F.try_parse_json("value").isNull())
    stops = read.where("bad").groupBy(F.col("file").alias("s_file")).agg(F.min(F.struct("block", "at")).alias("stop"))
    kept = read.join(stops, F.col("file") == F.col("s_file"), "left").where(F.col("stop").isNull() | (F.struct("block", "at") < F.col("stop")))
    return kept.select("row.*")


def _leaves(value: object, key: str = "") -> list[tuple[str, str]]:
    """(dotted key, JSON text) of a document's leaves; empty objects and lists are leaves."""
    if isinstance(value, dict) and value or isinstance(value, list) and value:
        items = value.items() if isinstance(value, dict) else enumerate(value)
        return [x for k, v in items for x in _leaves(v, f"{key}.{k}" if key else str(k))]
    return [(key, json.dumps(value, ensure_ascii=False, default=str))]


def _document(path: str, text: str) -> object:
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("no YAML reader is installed") from e
    return yaml.safe_load(text)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value, error): the leaves of settings documents, JSON, or YAML where a reader for it is
    installed. Keys are joined by dots, places in lists are numbers, values are JSON text. A document that
    cannot be read is one row with the reason, and an empty one has a single leaf without a key."""

    def run(batches):
        for pdf in batches:
            out = []
            for file, text in zip(pdf.file, pdf.value, strict=True):
                try:
                    out += [(file, k, v, None) for k, v in _leaves(_document(file, text))]
                except Exception as e:  # noqa: BLE001, any reader's own error
                    out.append((file, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file", "key", "value", "error"])

    docs = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    return docs.mapInPandas(run, "file string, key string, value string, error string")


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of WebVTT files: headers, cues and tags dropped, lines joined in order."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    kept = F.filter("l", lambda x: (F.trim(x) != "") & ~x.rlike(r"^(WEBVTT|Kind:|Language:|NOTE)|-->|^\d+$"))
    return lines.select("file", F.array_join(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))), " ").alias("text"))


@F.pandas_udf(ArrayType(ArrayType(FloatType())))
def _samples(content: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(data, pairs):
        with wave.open(io.BytesIO(data)) as w:
            rate, out = w.getframerate(), []
            for span in pairs:
                w.setpos(min(int(span["start"] * rate), w.getnframes()))
                out.append((np.frombuffer(w.readframes(max(0, int((span["end"] - span["start"]) * rate))), "<i2").astype(np.float32) / 32768).tolist())
            return out

    return pd.Series([cut(*x) for x in zip(content, spans)])


def wav_windows(spark: SparkSession, path: str, windows: DataFrame) -> DataFrame:
    """windows (file, start, end, ...) with the mono samples of each, read from 16-bit WAV files. A
    file's windows are gathered first, so its bytes move once and are cut in one place."""
    audio = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("_file"), "content")
    of = windows.groupBy("file").agg(F.collect_list(F.struct(*windows.columns)).alias("spans"))
    ends = F.transform("spans", lambda x: F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end")))
    cut = of.join(audio, F.col("file") == F.col("_file")).select("spans", _samples("content", ends).alias("cuts"))
    both = cut.select(F.explode(F.arrays_zip("spans", "cuts")).alias("x"))
    return both.select("x.spans.*", F.col("x.cuts").alias("samples"))


def header_rows(header: Column, row: Column) -> Column:
    """A record map from an API response's column names and one of its rows."""
    return F.map_from_arrays(header, row)


def collectors(spark: SparkSession, usable: dict[str, str | None]) -> DataFrame:
    """(platform, usable, reason): a platform is usable where no reason is given against it."""
    return spark.createDataFrame([(k, r is None, r) for k, r in usable.items()], "platform string, usable boolean, reason string")

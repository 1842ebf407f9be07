"""Structured Streaming over event streams: an extension, the batch operators' incremental side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; events later than `late` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Drops re-emitted events within the watermark: what a resumed producer sends twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def with_dimension(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return events.join(dimension, key, "left")


def upsert_sink(stream: DataFrame, path: str, name: str, order: str, checkpoint: str):
    """Each micro-batch is merged into the store table: a batch that runs again changes nothing."""
    from ..sources.writers import upsert_table

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert_table(df, path, name, order)).start()

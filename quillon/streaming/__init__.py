"""Streams over the event table: an extension beside the engine's batch queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """Files of a directory as a stream; a bound on files keeps a first run over old data in steps."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windowed(events: DataFrame, time: str, window: str, keys: list[str], aggs: list[Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by (sliding) window and keys; events later than ``late`` behind the newest are left out.

    The same call works on a batch, where the watermark has no effect.
    """
    stamp = F.col(time).cast("timestamp")
    rows = events.withColumn("__at", stamp).withWatermark("__at", late)
    slot = F.window("__at", window, slide) if slide else F.window("__at", window)
    return rows.groupBy(slot.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[F.col(c) for c in _names(aggs)])


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates by session: events of a key with less than ``gap`` between them."""
    rows = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    return rows.groupBy(F.session_window("__at", gap).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[F.col(c) for c in _names(aggs)])


def _names(aggs: list[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[1].strip("`") for a in aggs]


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First event of each key within the watermark."""
    return events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(keys).drop("__at")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """An exactly-once file sink; ``checkpoint`` lies on storage that outlives the driver."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()

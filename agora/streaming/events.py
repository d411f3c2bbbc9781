"""Structured Streaming extensions over an event stream.

The batch operators are the contract; these give the same numbers incrementally,
with late rows bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P


def read_events(spark: SparkSession, folder: str, schema: P.StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def label_counts(events: DataFrame, ts: str = "ts", label: str = "event_type", weight: str | None = None, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(period, topic_label, value): the time series of a label, per window."""
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = stamped.groupBy(F.window("_ts", window), F.col(label).alias("topic_label")).agg(w.alias("value"))
    return g.select(F.col("window.start").alias("period"), "topic_label", "value")


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


def write(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet", mode: str = "append"):
    return stream.writeStream.format(kind).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Tick stream -> hourly OHLCV bars (Structured Streaming, append mode).

Late ticks are accepted until the watermark (max event time - ``delay``) passes the
end of their hour; duplicates (same ``event_id``) are dropped within the watermark.
A bar is emitted once its hour is closed by the watermark, so output equals the
batch bars for every hour ending at or before max(ts) - delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KEY, TIME

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_event_stream(spark: SparkSession, directory: str, glob: str = "events*.parquet",
                      max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def stream_bars(events: DataFrame, unit: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Streaming bars keyed by (ticker, Date); event time cast to TIMESTAMP (UTC session)."""
    ev = (events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
          .withWatermark("ts", delay)
          .dropDuplicatesWithinWatermark(["event_id"]))
    bars = (ev.groupBy(F.window("ts", unit), F.col("event_type").alias(KEY))
            .agg(F.min_by("value", "ts").alias("Open"), F.max("value").alias("High"),
                 F.min("value").alias("Low"), F.max_by("value", "ts").alias("Close"),
                 F.count(F.lit(1)).cast("double").alias("Volume")))
    return bars.select(KEY, F.col("window.start").cast("timestamp_ntz").alias(TIME),
                       "Open", "High", "Low", "Close", "Volume")


def run_bars_available_now(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                           glob: str = "events*.parquet") -> DataFrame:
    """Process everything available, append closed bars to ``sink_dir``, return them."""
    q = (stream_bars(read_event_stream(spark, source_dir, glob))
         .writeStream.outputMode("append").format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink_dir)

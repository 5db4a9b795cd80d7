"""Structured Streaming over event rows (ts, user_id, event_type, value): beyond the batch operators, with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files: int = 1, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling (or sliding) window and type; late rows are taken up to the watermark."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rolled = held.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rolled.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    held = events.withWatermark("ts", late) if events.isStreaming else events
    rolled = held.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rolled.select("user_id", F.col("w.start").alias("start"), "n")


def running_mean(events: DataFrame, by: str = "event_type") -> DataFrame:
    """The mean so far; in a stream, updated by batch."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def running_confusion(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return predictions.groupBy(truth, pred).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, into a table in memory; for checks."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

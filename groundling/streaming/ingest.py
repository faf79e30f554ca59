"""Streaming ingestion of source lists: an extension; batches are routed and checked as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.routing import route


def routed_stream(spark: SparkSession, path: str) -> DataFrame:
    """Sources of text files that appear in a folder, each raw string once, routed."""
    lines = spark.readStream.text(path).select(strip(F.col("value")).alias("raw")).where("raw <> '' and raw not like '#%'")
    return route(lines.dropDuplicates(["raw"]))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start ``handle`` on every micro-batch until what is there has been read."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows, late ones within the watermark included."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")

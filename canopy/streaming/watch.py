"""Structured Streaming over folders of scans and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their mean value by type in windows of time; works on streams, where events later than ``late`` are left out, and on tables."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def watch(stream: DataFrame, checkpoint: str, target: str, key: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``work`` on each new batch and put the result under ``target``, a folder for each batch.  A batch that comes again overwrites its folder, so each counts once."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()

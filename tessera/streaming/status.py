"""Structured Streaming over status events: idempotent ingestion, running totals, restart from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema, at: str = "ts", files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; a zone-less event time becomes a timestamp, as watermarks need one."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return df.withColumn(at, F.col(at).cast("timestamp"))


def first_wins_stream(events: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once. State is dropped once the watermark passes, so it stays bounded; later repeats pass again."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_totals(events: DataFrame, keys: list[str], value: str, at: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and sum by event-time window; a window is given out once the watermark has passed its end."""
    totals = events.withWatermark(at, delay).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return totals.select(F.col("window.start").alias("start"), *keys, "n", "total")


def drain(stream: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Process all that is there, append it to a Parquet table, and stop; a rerun goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def drain_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every micro-batch to a function; with idempotent sinks the outcome is exactly once."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

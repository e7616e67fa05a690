"""Structured Streaming: incremental ingestion in micro-batches, and windowed event counts.

The batch operators stay the only place with logic. A file source remembers paths, so a modified file
isn't read again by it; ingestion therefore compares content hashes in each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """user_id, window_start and n: events of a user in a tumbling window, for tables and streams."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    counted = source.groupBy("user_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "n")


def over_limit(events: DataFrame, limit: int, minutes: int = 60) -> DataFrame:
    return rates(events, minutes).where(F.col("n") > limit)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end and n of runs of events without a longer gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    counted = source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``handle`` over what has arrived and stops; the checkpoint remembers how far it came."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Streaming forms of the aggregates: deduplicated intake, windowed counters, and upserts per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """The stream with a watermark on ``ts``, which may be a timestamp without a zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def deduplicated(stream: DataFrame, key: str, ts: str = "ts", late: str = "14 days") -> DataFrame:
    """Each key once; state older than the watermark is dropped, so it does not grow without end."""
    return _timed(stream, ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, key: str, ts: str = "ts", width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events and mean value per key and tumbling window."""
    counted = _timed(stream, ts, late).groupBy(F.window(ts, width), key)
    return counted.agg(F.count("*").alias("games"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "games", "mean_value")


def client_rates(stream: DataFrame, client: str, ts: str = "ts", width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Requests per client in a moving window."""
    return _timed(stream, ts, width).groupBy(F.window(ts, width, slide), client).agg(F.count("*").alias("requests"))


def run_once(frame: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a rerun with the same checkpoint goes on where this one ended."""
    return frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()

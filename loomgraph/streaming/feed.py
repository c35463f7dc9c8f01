"""The change feed: file events, debounced, as Changed and Removed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import watch_ignored


def debounced(events: DataFrame, millis: int = 500) -> DataFrame:
    """window_start, path, change, ts of the last event of each path in each window of ``millis``, of events (path, exists, ts): Changed
    where the path still exists, else Removed.  Paths in ignored folders don't count.  Works on batches and on streams with a
    watermark on ts; state is one event per path and window."""
    kept = events.filter(~watch_ignored(F.col("path")))
    last = kept.groupBy(F.window("ts", f"{millis} milliseconds").alias("w"), "path").agg(F.max(F.struct("ts", "exists")).alias("e"))
    return last.select(F.col("w.start").alias("window_start"), "path", F.when(F.col("e.exists"), "Changed").otherwise("Removed").alias("change"), F.col("e.ts").alias("ts"))


def run_available(stream: DataFrame, out: str, checkpoint: str, millis: int = 500, lateness: str = "10 seconds") -> DataFrame:
    """Debounce what a stream (path, exists, ts) has now, and end.  Each micro-batch appends the windows that it changed to the table at
    ``out``; of a window the row of the last batch holds, which is what is returned."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    feed = debounced(stream.withWatermark("ts", lateness), millis)
    feed.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(out)
    last = rows.groupBy("window_start", "path").agg(F.max_by(F.struct("change", "ts"), "batch").alias("e"))
    return last.select("window_start", "path", "e.change", "e.ts")

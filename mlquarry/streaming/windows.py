"""Statistics over streams of events: the same expressions on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str, value: str, keys: list[str], size: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Per window and keys: n, mean, population variance, least and largest value. On a stream, rows later than lateness
    behind the watermark are left out and windows are final once it has passed them."""
    source = events.withWatermark(time, lateness) if events.isStreaming else events
    groups = source.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys)
    x = F.col(value)
    out = groups.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.min(x).alias("low"), F.max(x).alias("high"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "variance", "low", "high")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Per session of keys, ended by a gap: start, end and n."""
    source = events.withWatermark(time, lateness) if events.isStreaming else events
    out = source.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def running_moments(stream: DataFrame, value: str, keys: list[str], checkpoint: str, table_path: str) -> StreamingQuery:
    """Counts, sums and sums of squares of every micro-batch written under table_path, one folder a batch, so that a batch
    that runs twice replaces itself; merged() adds them up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        x = F.col(value).cast("double")
        batch.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, variance) of all batches."""
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return total.select(*keys, "n", mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("variance"))

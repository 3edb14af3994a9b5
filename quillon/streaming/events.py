"""Event-time windows (an extension beyond the document pipeline) and micro-batch watchers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _watermarked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    """On a stream, with the watermark (which needs a timestamp with a zone)."""
    if not (events.isStreaming and late):
        return events
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, ts: str, value: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """Count and sum per key and tumbling window; on a stream, rows later than ``late`` are dropped."""
    events = _watermarked(events, ts, late)
    agg = events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), key, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions per key that end after a gap: start, end of the last event, number of events."""
    events = _watermarked(events, ts, late)
    agg = events.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"), F.max(ts).alias("session_last"))
    return agg.select(key, F.col("s.start").alias("session_start"), "session_last", "n")


def sliding(events: DataFrame, ts: str, value: str, key: str, width: str, slide: str, late: str | None = None) -> DataFrame:
    """Count and sum per key and window of ``width`` that begins every ``slide``: a row is in each window that holds it."""
    events = _watermarked(events, ts, late)
    agg = events.groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), key, "n", F.round("total", 4).alias("total"))


def first_of_each(events: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """One row for each key. A stream keeps the first that comes and knows a key as long as the watermark asks (``within``); a table
    gives the earliest row (ties: the smallest in all columns), as an aggregate."""
    if events.isStreaming:
        return _watermarked(events, ts, within).dropDuplicatesWithinWatermark(keys)
    rest = [ts, *[c for c in events.columns if c not in {ts, *keys}]]
    return events.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*events.columns)


def followed_by(causes: DataFrame, effects: DataFrame, key: str, ts: str, within: str, late: str | None = None, how: str = "inner") -> DataFrame:
    """Pairs of a cause and each later effect of the same key within a time (``key, <cause columns>, effect_<columns>``).

    On streams both sides carry a watermark, and the interval tells how long either side is kept; with ``left_outer`` a cause
    without an effect comes out once none can follow any more.
    """
    causes, effects = _watermarked(causes, ts, late), _watermarked(effects, ts, late)
    right = effects.select(*[F.col(c).alias(f"effect_{c}") for c in effects.columns])
    after = (F.col(f"effect_{ts}") > F.col(ts)) & (F.col(f"effect_{ts}") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return causes.join(right, (F.col(key) == F.col(f"effect_{key}")) & after, how).drop(f"effect_{key}")


def watch(
    spark: SparkSession, path: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 8
) -> StreamingQuery:
    """Handle new parquet files in micro-batches until none is left; a restart goes on after the last batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()

"""Continuous sync and live metrics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import versions as V


def read_files(
    spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None, **options: str
) -> DataFrame:
    """A folder of files as a stream; each new file is read once."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def sync(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    key: list[str] | None = None,
    cursor: str | None = None,
    name: str = "sync",
    interval: str | None = None,
) -> StreamingQuery:
    """Keep a stored table in step with a stream: merged by key, or appended without one.

    Without an ``interval`` (such as ``60 minutes``) the query takes all that is there and stops.
    The checkpoint takes the place of a cursor. A micro-batch may be delivered twice after a
    failure; one already in the table's log is skipped, so an append does not double.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        mark = f"{name}:{batch_id}"
        if V.has_batch(batch.sparkSession, root, mark):
            return
        if key:
            V.merge_into(batch, root, key, cursor, mark)
        else:
            V.append(batch, root, cursor, mark)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dedupe(stream: DataFrame, key: list[str], ts: str, lateness: str) -> DataFrame:
    """One row per key among rows no further apart than ``lateness``; state older than that is freed.

    Rows later than the watermark are dropped by Spark; rows without a time are not dropped.
    """
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, ts: str, width: str, lateness: str, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures per time window and dimension; windows past the watermark are final."""
    grouped = stream.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("_w"), *dims)
    return grouped.agg(*[c.alias(n) for n, c in measures.items()]).select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *dims, *measures
    )


def live_metric(
    windows: DataFrame, root: str, checkpoint: str, dims: list[str], name: str = "live_metric", interval: str | None = None
) -> StreamingQuery:
    """Store changing windows: each trigger replaces the windows it updated, open ones included."""
    key = ["window_start", *dims]

    def apply(batch: DataFrame, batch_id: int) -> None:
        mark = f"{name}:{batch_id}"
        if not V.has_batch(batch.sparkSession, root, mark):
            V.merge_into(batch, root, key, None, mark)

    writer = (
        windows.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name)
    )
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def sessions(stream: DataFrame, key: list[str], ts: str, gap: str, lateness: str, measures: dict[str, Column]) -> DataFrame:
    """Measures per session: rows of a key less than ``gap`` apart. Also for a table, which gives all sessions at once.

    A session's end is its last row's time plus the gap. Its state is freed once the watermark has passed the end; rows later than the watermark
    are dropped by Spark, and rows without a time belong to no session.
    """
    grouped = stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("_s"), *key)
    return grouped.agg(*[c.alias(n) for n, c in measures.items()]).select(
        *key, F.col("_s.start").alias("started"), F.col("_s.end").alias("ended"), *measures
    )


def keep_sessions(found: DataFrame, path: str, checkpoint: str, name: str = "sessions", interval: str | None = None) -> StreamingQuery:
    """Store each session once, when the watermark has passed its end; open ones wait in the state. The sink writes no row twice."""
    writer = found.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

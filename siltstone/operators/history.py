"""Newest rows per group, and the logs of queries and syncs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import small_frame

# How many messages and log rows are shown unless the caller says.
MESSAGES = 20
LOG_ROWS = 50
NO_CACHE = "The last sync succeeded elsewhere: this lake holds none of its tables, so sync the source again."

QUERY_LOG = "source string, sql string, rows bigint, ms bigint, status string, error string, created_at timestamp"


def last_n(df: DataFrame, group: str, order: str | list[str], n: int = MESSAGES) -> DataFrame:
    """The last n rows of each group by one or more columns; rows equal in all of them are in no order.

    Each task first keeps its own last n per group (a window group limit), so at most n rows per
    group and task are shuffled however large a group is.
    """
    columns = [order] if isinstance(order, str) else order
    newest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in columns])
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def latest(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The newest row of each group."""
    newest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def log_query(spark: SparkSession, path: str, entry: tuple) -> None:
    """Append one (source, sql, rows, ms, status, error, created_at) row to the query log."""
    small_frame(spark, [entry], QUERY_LOG).coalesce(1).write.mode("append").parquet(path)


def queries(log: DataFrame, source: str, limit: int = LOG_ROWS) -> DataFrame:
    """The newest logged queries of a source."""
    return log.filter(F.col("source") == source).orderBy(F.desc("created_at"), "sql").limit(limit)


def syncs(log: DataFrame, source: str, limit: int = LOG_ROWS) -> DataFrame:
    """The newest sync reports of a source."""
    return log.filter(F.col("source") == source).orderBy(F.desc("finished_at"), "table").limit(limit)


def sync_status(configs: DataFrame, stored: DataFrame, running: DataFrame) -> DataFrame:
    """Effective status per source.

    ``configs``: source, status, last_sync_at, rows_cached, error. ``stored``: source, tables (the
    tables really there). ``running``: source. A success without any stored table counts as never
    synced, and a running sync shows as running whatever the last one did.
    """
    joined = (
        configs.join(stored, "source", "left")
        .join(running.select("source", F.lit(True).alias("_running")), "source", "left")
        .withColumn("is_syncing", F.coalesce("_running", F.lit(False)))
    )
    has_tables = F.size(F.coalesce("tables", F.array().cast("array<string>"))) > 0
    lost = ~F.col("is_syncing") & (F.col("status") == "success") & ~has_tables
    status = F.when(F.col("is_syncing"), "running").when(F.coalesce(lost, F.lit(False)), "never")
    kept = lambda c: F.when(~F.coalesce(lost, F.lit(False)), F.col(c))
    return joined.select(
        "source",
        F.coalesce(status, "status", F.lit("never")).alias("status"),
        kept("last_sync_at").alias("last_sync_at"),
        F.coalesce(kept("rows_cached"), F.lit(0)).alias("rows_cached"),
        F.coalesce("tables", F.array().cast("array<string>")).alias("tables_cached"),
        "is_syncing",
        F.when(lost, NO_CACHE).when(F.col("status") != "success", F.col("error")).alias("error"),
    )

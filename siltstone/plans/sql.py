"""SQL over the tables of any number of sources."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.history import log_query


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables known to SQL; ``source.table`` becomes ``source__table``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name.replace(".", "__"))


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The lazy result of one statement over registered tables."""
    register(tables or {})
    return spark.sql(text)


def limited(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A result cut to a limit if one is given; nothing else cuts it."""
    return df if limit is None else df.limit(limit)


def run_logged(spark: SparkSession, source: str, text: str, log_path: str, out_path: str, limit: int | None = None) -> DataFrame:
    """Run a statement, keep its result (cut only by a given limit) as Parquet and log rows, time and status.

    Rows are counted while they are written, so the statement runs once.
    """
    started = time.monotonic()
    now = datetime.now(timezone.utc)
    spent = lambda: int((time.monotonic() - started) * 1000)
    try:
        seen = Observation()
        limited(spark.sql(text), limit).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out_path)
        log_query(spark, log_path, (source, text, seen.get.get("rows", 0), spent(), "success", None, now))
    except Exception as e:
        log_query(spark, log_path, (source, text, 0, spent(), "failed", str(e), now))
        raise
    return spark.read.parquet(out_path)

"""Database tables and cursor scans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.sync import CURSOR_COLUMNS

# Rows per partition a scan aims at, and rows per round trip; larger tables get larger fetches.
PARTITION_ROWS = 1_000_000
FETCH_SIZES = ((10_000, 1_000), (100_000, 5_000))
FETCH_SIZE_LARGE = 20_000


def pick_cursor(df: DataFrame) -> str | None:
    """The first usual change-time column the table has."""
    return next((c for c in CURSOR_COLUMNS if c in df.columns), None)


def high_water_mark(df: DataFrame, cursor: str) -> DataFrame:
    """Newest cursor value, as one row."""
    return df.agg(F.max(cursor).alias("high_water_mark"))


def read_since(df: DataFrame, cursor: str, last: Column | None) -> DataFrame:
    """Rows with a cursor above ``last``; the filter reaches the scan. NULL cursors are left out."""
    return df if last is None else df.filter(F.col(cursor) > last)


def fetch_size(row_count: int) -> int:
    return next((size for upto, size in FETCH_SIZES if row_count <= upto), FETCH_SIZE_LARGE)


def partition_predicates(
    column: str, low: int, high: int, rows: int, include_null: bool = True, partition_rows: int = PARTITION_ROWS
) -> list[str]:
    """WHERE clauses that split a table by ranges of an integer column, each row in exactly one."""
    parts = max(1, min(-(-rows // partition_rows), high - low + 1))
    edges = [low + (high - low + 1) * i // parts for i in range(1, parts)]
    if not edges:
        clauses = [f"{column} IS NOT NULL"] if not include_null else ["1 = 1"]
        return clauses
    clauses = [f"{column} < {edges[0]}"]
    clauses += [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:])]
    clauses.append(f"{column} >= {edges[-1]}")
    if include_null:
        clauses[0] = f"({clauses[0]} OR {column} IS NULL)"
    return clauses


def cursor_predicate(cursor: str, last: str | datetime | None) -> str | None:
    """``cursor > last`` as text for a database."""
    if last is None:
        return None
    text = last.isoformat(sep=" ") if isinstance(last, datetime) else str(last)
    return f"{cursor} > '{text.replace(chr(39), chr(39) * 2)}'"


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    cursor: str | None = None,
    last: str | datetime | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of any JDBC database, read in parallel by ranges of an integer key.

    One aggregate query fetches the key's range and the row count; without a key the table is one
    partition. An incremental read puts the cursor condition into every partition's query.
    """
    props = dict(properties or {})
    newer = cursor_predicate(cursor, last) if cursor else None
    if key is None:
        df = spark.read.jdbc(url, table, properties=props)
        return df if newer is None else df.filter(newer)
    where = f" WHERE {newer}" if newer else ""
    bounds = spark.read.jdbc(
        url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {table}{where}) b", properties=props
    ).first()
    props["fetchsize"] = str(fetch_size(bounds["n"]))
    if bounds["lo"] is None:
        predicates = ["1 = 1"]
    else:
        predicates = partition_predicates(key, int(bounds["lo"]), int(bounds["hi"]), int(bounds["n"]))
    if newer:
        predicates = [f"({p}) AND {newer}" for p in predicates]
    return spark.read.jdbc(url, table, predicates=predicates, properties=props)

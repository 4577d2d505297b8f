"""Raw (bronze) and refined (silver) layers over versioned Parquet."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import versions as V
from siltstone.operators.drift import CHANGES
from siltstone.operators.drift import check as check_drift
from siltstone.session import small_frame, union_all


@dataclass(frozen=True)
class Lake:
    """Two layers below one shared folder."""

    base: str

    def bronze(self, source: str, name: str) -> str:
        return f"{self.base}/bronze/{source}/{name}"

    def silver(self, source: str, name: str) -> str:
        return f"{self.base}/silver/{source}/{name}"


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table in one job; Parquet answers from its footers."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("model", F.lit(m)) for m, df in tables.items()]
    return union_all(counts).select("model", "row_count")


def write_bronze(lake: Lake, source: str, name: str, df: DataFrame, policy: str = "evolve") -> DataFrame:
    """Replace a raw table with ``df`` and return the schema changes since its last version.

    An empty input writes nothing. ``policy='freeze'`` refuses changes that need review before
    anything is written.
    """
    root = lake.bronze(source, name)
    changes = check_drift(V.schema(df.sparkSession, root), df.schema, name, policy)
    V.replace(df, root)
    follow(df.sparkSession, lake, source, name)
    return small_frame(df.sparkSession, changes, CHANGES)


def read_bronze(
    spark: SparkSession, lake: Lake, source: str, name: str, columns: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """A raw table, or some of its columns and first rows."""
    df = V.read(spark, lake.bronze(source, name))
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit else df


def choose_strategy(cursor: str | None, key: list[str] | None) -> str:
    """What is declared of a table decides, never its size: with cursor and key incremental, with one of them full, else a view.

    Every strategy refines the same raw table to the same rows.
    """
    if cursor and key:
        return "incremental"
    return "full" if cursor or key else "view"


def view_name(source: str, name: str) -> str:
    return f"{source}__{name}"


def follow(spark: SparkSession, lake: Lake, source: str, name: str) -> None:
    """Point the view of a table that is refined as a view to its newest raw rows."""
    view = view_name(source, name)
    if spark.catalog.tableExists(view) and V.latest(spark, lake.silver(source, name)) is None:
        V.read(spark, lake.bronze(source, name)).createOrReplaceTempView(view)


def stored_tables(spark: SparkSession, lake: Lake, layer: str, source: str, names: list[str]) -> DataFrame:
    """Which of the named tables a layer holds, with their newest version and an upper bound of their rows."""
    found = []
    for name in names:
        v = V.latest(spark, getattr(lake, layer)(source, name))
        if v is not None:
            found.append((source, name, v.version, v.total_rows))
    return small_frame(spark, found, "source string, table string, version bigint, rows bigint")


def drop(spark: SparkSession, lake: Lake, layer: str, source: str, name: str) -> bool:
    """Remove a table of a layer with all its versions and, with its last layer, its view. Whether there was one."""
    there = V.remove(spark, getattr(lake, layer)(source, name))
    left = [x for x in ("bronze", "silver") if V.latest(spark, getattr(lake, x)(source, name)) is not None]
    if there and not left:
        spark.catalog.dropTempView(view_name(source, name))
    return there


def materialize(
    spark: SparkSession,
    lake: Lake,
    source: str,
    name: str,
    strategy: str = "auto",
    cursor: str | None = None,
    on_tie: str | None = None,
    key: list[str] | None = None,
) -> dict:
    """Refine one raw table and register it as the view ``<source>__<name>``.

    auto: see ``choose_strategy``. view: nothing is copied and the view follows the raw table. full: the raw
    table is copied. incremental with a key: rows from the refined table's newest cursor value on, and rows without
    a value, are merged by the key, so updates, ties and rows without a cursor arrive; rows deleted from the
    raw table stay. Without a key only rows above the newest value are added (``on_tie='skip'``).
    """
    bronze, silver = lake.bronze(source, name), lake.silver(source, name)
    raw = V.latest(spark, bronze)
    if raw is None:
        return _report(source, name, "error", error=f"no raw table for {name}")
    if strategy == "auto":
        strategy = choose_strategy(cursor, key)
    on_tie = on_tie or ("merge" if key else "skip")
    view = view_name(source, name)
    df = V.read(spark, bronze)
    if strategy == "view":
        df.createOrReplaceTempView(view)
        return _report(source, name, "success", "view", 0)

    newest = None
    if strategy == "incremental":
        if not cursor:
            raise ValueError("an incremental refresh needs a cursor column")
        newest = V.high_water(spark, silver, cursor)
    if newest is None:
        rows = V.replace(df, silver, cursor)
        kind = "table"
    elif on_tie == "merge":
        if not key:
            raise ValueError("merging equal cursor values needs a key")
        rows = V.merge_into(df.filter((F.col(cursor) >= newest) | F.col(cursor).isNull()), silver, key, cursor)
        kind = "incremental"
    else:
        rows = V.append(df.filter(F.col(cursor) > newest), silver, cursor)
        kind = "incremental"
    if V.latest(spark, silver) is not None:
        V.read(spark, silver).createOrReplaceTempView(view)
    return _report(source, name, "success", kind, rows)


def _report(source: str, name: str, status: str, kind: str | None = None, rows: int = 0, error: str | None = None) -> dict:
    return {"source": source, "table": name, "status": status, "type": kind, "rows": rows, "error": error}


def materialize_all(
    spark: SparkSession,
    lake: Lake,
    source: str,
    names: list[str],
    cursors: dict[str, str] | None = None,
    strategy: str = "auto",
    keys: dict[str, list[str]] | None = None,
    at_once: int = 4,
) -> DataFrame:
    """Refine the tables of a source, ``at_once`` of them together; one report row per table, failures included."""

    def one(name: str) -> dict:
        try:
            return materialize(spark, lake, source, name, strategy, (cursors or {}).get(name), key=(keys or {}).get(name))
        except Exception as e:  # a broken table must not stop the others
            return _report(source, name, "error", error=str(e))

    with ThreadPoolExecutor(at_once) as pool:
        reports = list(pool.map(one, names))
    rows = [(r["source"], r["table"], r["status"], r["type"], r["rows"], r["error"]) for r in reports]
    return small_frame(spark, rows, "source string, table string, status string, type string, rows bigint, error string")

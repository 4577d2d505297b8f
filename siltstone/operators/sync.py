"""Loads into the raw layer: replace, append and merge by key."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.values import FULL_TIMES
from siltstone.operators import drift
from siltstone.operators import versions as V
from siltstone.operators.layers import Lake, follow
from siltstone.session import small_frame

# Names of cursor columns in order of preference, and the first cursor value.
CURSOR_COLUMNS = ["updated_at", "modified_at", "last_modified", "created_at"]
FIRST_CURSOR = "1970-01-01T00:00:00Z"

REPORT = (
    "source string, table string, status string, mode string, is_incremental boolean, rows_synced bigint, "
    "schema_changes bigint, schema_review_required boolean, duration_seconds double, error string"
)


def since(df: DataFrame, cursor: str, last: Column | None) -> DataFrame:
    """Rows from the last cursor value on, and rows that have none.

    Rows equal to the last value are taken again, as some may have arrived later; the merge, or ``unseen``
    where there is no key, leaves those out that are already there.
    """
    return df if last is None else df.filter((F.col(cursor) >= last) | F.col(cursor).isNull())


def unseen(df: DataFrame, stored: DataFrame | None, cursor: str, last: Column | None) -> DataFrame:
    """Of the rows ``since`` a cursor value those that are not stored yet, copies counted.

    Only the edge (rows equal to the value and rows without one) is compared with the stored edge, by digests of the rows.
    """
    if stored is None or last is None or not set(df.columns) <= set(stored.columns):
        return df
    on_edge = F.col(cursor).isNull() | (F.col(cursor) == last)
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), FULL_TIMES), 256)
    held = stored.filter(on_edge).groupBy(digest.alias("_held")).agg(F.count(F.lit(1)).alias("_n"))
    numbered = df.filter(on_edge).withColumn("_digest", digest)
    numbered = numbered.withColumn("_r", F.row_number().over(Window.partitionBy("_digest").orderBy(F.lit(1))))
    fresh = numbered.join(held, F.col("_digest") == F.col("_held"), "left").filter(F.col("_r") > F.coalesce("_n", F.lit(0)))
    return df.filter(F.col(cursor) > last).unionByName(fresh.select(*[F.col(f"`{c}`") for c in df.columns]))


def load(
    lake: Lake,
    source: str,
    name: str,
    df: DataFrame,
    key: list[str] | None = None,
    cursor: str | None = None,
    incremental: bool = False,
    policy: str = "evolve",
    fallback: bool = True,
    initial: str | None = None,
) -> dict:
    """Load a source table into the raw layer and report on it.

    A full load replaces the table. An incremental one takes the rows from the newest cursor
    value on and those without a value, and merges them by key, or appends those not stored yet if there is no key
    (``id`` is the key when none is given). ``df`` is the whole source: the cursor filter is
    applied here and reaches its scan, and an increment that cannot be applied is reloaded in full
    from it, which the report shows as not incremental.
    """
    spark = df.sparkSession
    root = lake.bronze(source, name)
    started = time.monotonic()
    keys = key or (["id"] if "id" in df.columns else None)
    mode = "replace" if not incremental else ("merge" if keys else "append")
    report = {"source": source, "table": name, "status": "success", "mode": mode, "is_incremental": incremental}
    changes: list[drift.Change] = []
    try:
        changes = drift.check(V.schema(spark, root), df.schema, name, policy)
        if not incremental:
            rows = V.replace(df, root, cursor)
        else:
            last = V.high_water(spark, root, cursor) if cursor else None
            if cursor and last is None and initial is not None:
                last = F.lit(initial).cast(df.schema[cursor].dataType)
            fresh = since(df, cursor, last) if cursor else df
            if keys:
                rows = V.merge_into(fresh, root, keys, cursor)
            else:
                stored = V.read(spark, root) if V.latest(spark, root) else None
                rows = V.append(unseen(fresh, stored, cursor, last) if cursor else fresh, root, cursor)
    except drift.SchemaFrozen as e:
        rows, report = 0, {**report, "status": "failed", "error": str(e)}
    except (AnalysisException, TypeError) as e:
        if not (incremental and fallback):
            rows, report = 0, {**report, "status": "failed", "error": str(e)}
        else:
            rows = V.replace(df, root, cursor)
            report |= {"mode": "replace", "is_incremental": False}
    if V.latest(spark, root) is not None:
        follow(spark, lake, source, name)
    return {
        "error": None,
        **report,
        "rows_synced": rows,
        "schema_changes": len(changes),
        "schema_review_required": any(c[5] for c in changes),
        "duration_seconds": time.monotonic() - started,
    }


def load_incremental(
    lake: Lake, source: str, name: str, df: DataFrame, key: list[str] | None = None, cursor: str = "updated_at",
    initial: str = FIRST_CURSOR,
) -> dict:
    """Merge by key the rows above the cursor, starting from ``initial`` on the first run."""
    return load(lake, source, name, df, key or ["id"], cursor, True, initial=initial)


def run(
    lake: Lake,
    source: str,
    tables: dict[str, DataFrame],
    keys: dict[str, list[str]] | None = None,
    cursors: dict[str, str] | None = None,
    incremental: bool = False,
    policy: str = "evolve",
    at_once: int = 4,
) -> DataFrame:
    """Load several tables of a source, ``at_once`` of them together; one report row per table, also kept in the sync log."""

    def one(name: str) -> dict:
        return load(lake, source, name, tables[name], (keys or {}).get(name), (cursors or {}).get(name), incremental, policy)

    with ThreadPoolExecutor(at_once) as pool:
        reports = list(pool.map(one, tables))
    spark = next(iter(tables.values())).sparkSession
    frame = report_frame(spark, reports)
    frame.withColumn("finished_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{lake.base}/_syncs")
    return frame


def report_frame(spark: SparkSession, reports: list[dict]) -> DataFrame:
    names = T.StructType.fromDDL(REPORT).names
    return small_frame(spark, [tuple(r[n] for n in names) for r in reports], REPORT)


def is_due(last_sync: Column, interval_minutes: Column, now: Column) -> Column:
    """Never synced, or the interval (60 minutes if unset, 5 at least) has passed."""
    minutes = F.greatest(F.coalesce(interval_minutes, F.lit(60)), F.lit(5))
    return last_sync.isNull() | (last_sync + F.make_dt_interval(mins=minutes) <= now)

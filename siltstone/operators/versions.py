"""Tables as Parquet segments with an append-only log of finished loads.

A load writes its rows to a folder of its own and then adds one row to the log. Readers take the
folders named by the newest log row, so an unfinished or failed load is never seen and nothing is
overwritten while it is being read. One writer per table is assumed.

A merge adds its increment as a delta next to the base segments instead of rewriting them; reading
joins the two. Deltas are folded together when there are many, and into the base when they have
grown to a tenth of it, so a small increment costs what it holds and not what the table holds.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from dataclasses import replace as replaced
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.merge import align, dedupe, extend_schema, fold
from siltstone.operators.merge import merge as merge_rows
from siltstone.session import path_exists, small_frame

LOG = (
    "version bigint, mode string, segments array<string>, deltas array<string>, merge_key array<string>, rows bigint, "
    "base_rows bigint, delta_rows bigint, schema_json string, cursor string, high_water string, batch string, "
    "written_at timestamp"
)

# Deltas are folded into the base from this share of its rows, and into one from this number.
COMPACT_SHARE = 0.1
MAX_DELTAS = 16


@dataclass(frozen=True)
class Version:
    version: int
    mode: str
    segments: list[str]
    deltas: list[str]
    merge_key: list[str]
    rows: int
    base_rows: int
    delta_rows: int
    schema: T.StructType
    cursor: str | None
    high_water: str | None

    @property
    def total_rows(self) -> int:
        """Rows of base and deltas; an upper bound while there are deltas."""
        return self.base_rows + self.delta_rows


def _entries(spark: SparkSession, root: str) -> list[str]:
    """The names of the log's finished entries, oldest first: a folder each, ``<version>-<digest of the batch>``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_loads")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(at) if path_exists(spark, f"{s.getPath()}/_SUCCESS"))


def log(spark: SparkSession, root: str) -> DataFrame:
    """All finished loads of a table, oldest first (empty for a new table)."""
    names = _entries(spark, root)
    if not names:
        return small_frame(spark, [], LOG)
    return spark.read.schema(LOG).json([f"{root}/_loads/{n}" for n in names]).orderBy("version")


def latest(spark: SparkSession, root: str) -> Version | None:
    """The newest finished load, by the name of its entry; no other entry is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_loads")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    names = sorted((s.getPath().getName() for s in system.listStatus(at)), reverse=True)
    # An entry that was broken off before its commit does not count.
    newest = next((n for n in names if path_exists(spark, f"{root}/_loads/{n}/_SUCCESS")), None)
    if newest is None:
        return None
    r = spark.read.schema(LOG).json(f"{root}/_loads/{newest}").first()
    schema = T.StructType.fromJson(json.loads(r.schema_json))
    return Version(
        r.version, r.mode, r.segments, r.deltas, r.merge_key, r.rows, r.base_rows, r.delta_rows, schema, r.cursor, r.high_water
    )


def schema(spark: SparkSession, root: str) -> T.StructType | None:
    v = latest(spark, root)
    return v.schema if v else None


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table as of its newest load; columns added later are NULL in older segments."""
    v = latest(spark, root)
    if v is None:
        raise ValueError(f"no finished load in {root}")
    return _read(spark, root, v)


def _read(spark: SparkSession, root: str, v: Version) -> DataFrame:
    base = spark.read.schema(v.schema).parquet(*_paths(root, v.segments))
    if not v.deltas:
        return base
    return merge_rows(base, _deltas(spark, root, v), v.merge_key, v.cursor)


def _deltas(spark: SparkSession, root: str, v: Version) -> DataFrame:
    return fold([spark.read.schema(v.schema).parquet(p) for p in _paths(root, v.deltas)], v.merge_key, v.cursor)


def remove(spark: SparkSession, root: str) -> bool:
    """Delete a stored table with its log; readers of it fail from then on. Whether there was one."""
    there = path_exists(spark, root)
    if there:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return there


def clean(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders that the newest version does not name and return their names.

    Call it when no reader of an older version and no load is under way.
    """
    v = latest(spark, root)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if v is None or not system.exists(at):
        return []
    gone = [s.getPath() for s in system.listStatus(at) if s.getPath().getName() not in {*v.segments, *v.deltas}]
    for path in gone:
        system.delete(path, True)
    return sorted(p.getName() for p in gone)


def has_batch(spark: SparkSession, root: str, batch: str) -> bool:
    """Whether a micro-batch is already in the log, by the names of its entries."""
    return any(n.endswith(f"-{_tag(batch)}") for n in _entries(spark, root))


def high_water(spark: SparkSession, root: str, cursor: str) -> Column | None:
    """Newest cursor value as a typed literal, or None for a new table or one without values.

    Loads note it in the log; a cursor they did not follow is read with one max.
    """
    v = latest(spark, root)
    if v is None:
        return None
    text = v.high_water
    if v.cursor != cursor:
        text = _read(spark, root, v).agg(F.max(cursor).cast("string")).first()[0]
    return None if text is None else F.lit(text).cast(v.schema[cursor].dataType)


def replace(df: DataFrame, root: str, cursor: str | None = None, mode: str = "replace", batch: str | None = None) -> int:
    """Write ``df`` as the whole new version; an empty one writes nothing. Returns its rows."""
    return _replace(df, root, latest(df.sparkSession, root), cursor, mode, batch)


def _replace(df: DataFrame, root: str, v: Version | None, cursor: str | None, mode: str, batch: str | None) -> int:
    number = _next(v)
    rows, newest = _write(df, root, number, cursor)
    if rows:
        new = Version(number, mode, [_name(number)], [], [], rows, rows, 0, df.schema, cursor, newest)
        _commit(df.sparkSession, root, new, batch)
    return rows


def append(df: DataFrame, root: str, cursor: str | None = None, batch: str | None = None) -> int:
    """Add rows to the table as one more segment and return how many.

    New columns extend the table; a column of another type is refused.
    """
    spark = df.sparkSession
    v = latest(spark, root)
    if v is None:
        return _replace(df, root, None, cursor, "append", batch)
    merged = extend_schema(v.schema, df.schema)
    if v.deltas:
        v = compact(spark, root, v)
    number = _next(v)
    rows, newest = _write(align(df, merged), root, number, cursor)
    if rows:
        newest = _raise_mark(spark, root, v, cursor, newest, merged)
        segments = [*v.segments, _name(number)]
        new = Version(number, "append", segments, [], [], rows, v.base_rows + rows, 0, merged, cursor, newest)
        _commit(spark, root, new, batch)
    return rows


def merge_into(
    df: DataFrame, root: str, key: list[str], cursor: str | None = None, batch: str | None = None,
    compact_share: float = COMPACT_SHARE,
) -> int:
    """Merge rows into a stored table by key and return the rows of the increment, one per key."""
    spark = df.sparkSession
    v = latest(spark, root)
    unique = dedupe(df, key, cursor)
    if v is None:
        return _replace(unique, root, None, cursor, "merge", batch)
    merged = extend_schema(v.schema, df.schema)
    if v.deltas and (v.merge_key != key or v.cursor != cursor):
        v = compact(spark, root, v)
    number = _next(v)
    rows, newest = _write(align(unique, merged), root, number, cursor)
    if not rows:
        return 0
    newest = _raise_mark(spark, root, v, cursor, newest, merged)
    deltas, changed = [*v.deltas, _name(number)], v.delta_rows + rows
    new = Version(number, "merge", v.segments, deltas, key, rows, v.base_rows, changed, merged, cursor, newest)
    _commit(spark, root, new, batch)
    if new.delta_rows > compact_share * new.base_rows:
        compact(spark, root, new)
    elif len(new.deltas) >= MAX_DELTAS:
        _fold_deltas(spark, root, new)
    return rows


def compact(spark: SparkSession, root: str, v: Version | None = None) -> Version:
    """Write base and deltas as one new base."""
    v = v or latest(spark, root)
    number = _next(v)
    rows, newest = _write(_read(spark, root, v), root, number, v.cursor)
    new = Version(number, "compact", [_name(number)], [], [], 0, rows, 0, v.schema, v.cursor, newest)
    _commit(spark, root, new, None)
    return new


def _fold_deltas(spark: SparkSession, root: str, v: Version) -> None:
    number = _next(v)
    rows, _ = _write(_deltas(spark, root, v), root, number, None)
    _commit(spark, root, replaced(v, version=number, mode="fold", deltas=[_name(number)], rows=0, delta_rows=rows), None)


def _next(v: Version | None) -> int:
    return v.version + 1 if v else 1


def _name(number: int) -> str:
    return f"v{number:08d}"


def _paths(root: str, names: list[str]) -> list[str]:
    return [f"{root}/data/{n}" for n in names]


def _write(df: DataFrame, root: str, number: int, cursor: str | None) -> tuple[int, str | None]:
    """Write one folder; rows and newest cursor value are counted while writing."""
    seen = Observation()
    newest = F.max(cursor) if cursor else F.lit(None)
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), newest.cast("string").alias("newest"))
    watched.write.mode("overwrite").option("compression", "snappy").parquet(_paths(root, [_name(number)])[0])
    got = seen.get
    return got.get("rows", 0), got.get("newest")


def _raise_mark(
    spark: SparkSession, root: str, v: Version, cursor: str | None, newest: str | None, schema: T.StructType
) -> str | None:
    """The later of the table's and the increment's newest cursor value."""
    if cursor is None:
        return None
    before = v.high_water
    if v.cursor != cursor and cursor in v.schema.names:
        before = _read(spark, root, v).agg(F.max(cursor).cast("string")).first()[0]
    dt = schema[cursor].dataType
    both = small_frame(spark, [(before, newest)], "a string, b string")
    return both.select(F.greatest(F.col("a").cast(dt), F.col("b").cast(dt)).cast("string")).first()[0]


def _commit(spark: SparkSession, root: str, v: Version, batch: str | None) -> None:
    entry = (
        v.version, v.mode, v.segments, v.deltas, v.merge_key, v.rows, v.base_rows, v.delta_rows, v.schema.json(), v.cursor,
        v.high_water, batch, datetime.now(timezone.utc),
    )
    at = f"{root}/_loads/{v.version:010d}-{_tag(batch)}"
    small_frame(spark, [entry], LOG).coalesce(1).write.mode("overwrite").json(at)


def _tag(batch: str | None) -> str:
    return hashlib.sha256(batch.encode()).hexdigest()[:32] if batch is not None else "load"

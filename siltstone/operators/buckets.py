"""Upserts that rewrite only the part of a table that an increment touches.

A table is dealt into partitions by the hash of its key. An increment is dealt the same way; only the partitions that
it has rows for are read, merged and written back by dynamic partition overwrite. All others keep
their files. Readers read plain Parquet, so a column read is a column scan and a read by key is a read of one partition.

An upsert that breaks off while its partitions are put in place is repeated: the same increment gives the same table.
One writer at a time is assumed, as with every overwrite of files. ``deal`` states how many partitions there are; it
belongs to the table and is kept in its folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.merge import align, dedupe, extend_schema, newest, with_no_key
from siltstone.session import path_exists, small_frame

#: The column that names the partition; it is the folder's and not part of the rows.
PART = "_part"


def deal(key: list[str], parts: int) -> Column:
    """The partition of a row by the hash of its key; rows without a full key are dealt by what they have."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in key]), F.lit(parts)).cast("int")


def create(df: DataFrame, root: str, key: list[str], parts: int, cursor: str | None = None) -> None:
    """Write a new table with one row per key (the newest by cursor, then by content)."""
    spark = df.sparkSession
    if path_exists(spark, f"{root}/_deal"):
        raise ValueError(f"{root} is already a table")
    _write(dedupe(df, key, cursor).withColumn(PART, deal(key, parts)), f"{root}/rows")
    small_frame(spark, [(key, parts, cursor)], "key array<string>, parts int, cursor string").coalesce(1).write.json(f"{root}/_deal")


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{root}/rows").drop(PART)


def lookup(spark: SparkSession, root: str, values: dict[str, object]) -> DataFrame:
    """The row of one key, read from its partition alone."""
    key, parts, _ = _dealt(spark, root)
    rows = spark.read.option("mergeSchema", True).parquet(f"{root}/rows")
    wanted = [F.lit(values[k]).cast(rows.schema[k].dataType) for k in key]
    part = spark.range(1).select(F.pmod(F.xxhash64(*[w.cast("string") for w in wanted]), F.lit(parts)).cast("int")).first()[0]
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == w for k, w in zip(key, wanted)])
    return rows.filter((F.col(PART) == part) & same).drop(PART)


def upsert(df: DataFrame, root: str) -> list[int]:
    """Merge an increment by the table's key and return the partitions that were written.

    Per key the newer row by the table's cursor wins, the incoming one on ties and without a cursor. New columns extend
    the table; partitions that are not touched have them as NULL when read. A column of another type raises.
    """
    spark = df.sparkSession
    key, parts, cursor = _dealt(spark, root)
    incoming = dedupe(df, key, cursor).withColumn(PART, deal(key, parts))
    # At most as many numbers as the table has partitions.
    touched = sorted(r[0] for r in incoming.select(PART).distinct().collect())
    if not touched:
        return []
    stored = spark.read.option("mergeSchema", True).parquet(f"{root}/rows")
    base = stored.filter(F.col(PART).isin(touched))
    both = extend_schema(base.schema, incoming.schema)
    rows = align(base, both).withColumn("_incoming", F.lit(0)).unionByName(align(incoming, both).withColumn("_incoming", F.lit(1)))
    order = [F.col(cursor).desc_nulls_last()] if cursor else []
    keyed = with_no_key(rows, key, ignore=("_incoming", PART))
    merged = newest(keyed, [*key, PART], [*order, F.desc("_incoming")]).drop("_no_key", "_incoming")
    _write(merged, f"{root}/rows")
    return touched


def _dealt(spark: SparkSession, root: str) -> tuple[list[str], int, str | None]:
    r = spark.read.schema("key array<string>, parts int, cursor string").json(f"{root}/_deal").first()
    return r["key"], r["parts"], r["cursor"]


def _write(df: DataFrame, path: str) -> None:
    """Rows of a partition come together first, so each is written by one task as one file."""
    dealt = df.repartition(PART)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)

"""Upserts as joins: one row per key, the newest wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.values import FULL_TIMES


def extend_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """The old fields plus the new ones; a type change raises."""
    known = {f.name: f for f in old.fields}
    for f in new.fields:
        if f.name in known and known[f.name].dataType != f.dataType:
            raise TypeError(
                f"column {f.name} changed from {known[f.name].dataType.simpleString()} to {f.dataType.simpleString()}"
            )
    return T.StructType([*old.fields, *[f for f in new.fields if f.name not in known]])


def align(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` with exactly the target's columns, missing ones NULL."""
    return df.select(
        *[
            F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def with_no_key(df: DataFrame, key: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Add ``_no_key``, a content hash for rows without a full key, so that even they are merged only once."""
    missing = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in key])
    cells = [F.col(f"`{c}`") for c in sorted(df.columns) if c not in ignore]
    return df.withColumn("_no_key", F.when(missing, F.sha2(F.to_json(F.struct(*cells), FULL_TIMES), 256)))


def newest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key (and ``_no_key``), the first in the given order.

    Spark keeps only the first row per key of each task before it shuffles, so a key repeated
    many times in an increment does not gather in one place.
    """
    by_key = Window.partitionBy(*key, "_no_key").orderBy(*order)
    return df.withColumn("_r", F.row_number().over(by_key)).filter("_r = 1").drop("_r")


def dedupe(df: DataFrame, key: list[str], cursor: str | None = None) -> DataFrame:
    """The newest row per key of one increment (by cursor, then by content)."""
    content = F.xxhash64(
        *[
            F.to_json(F.col(f"`{f.name}`"), FULL_TIMES) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
    order = [F.col(cursor).desc_nulls_last()] if cursor else []
    return newest(with_no_key(df, key), key, [*order, content]).drop("_no_key")


def merge(target: DataFrame, increment: DataFrame, key: list[str], cursor: str | None = None) -> DataFrame:
    """``target`` after an increment that holds at most one row per key.

    Keys the increment does not name are kept as they are. For the others the incoming row wins, or
    with a cursor the newer one (incoming on ties). The target is only filtered, by keys and cursor: next to an
    increment small enough to broadcast it is neither shuffled nor sorted, and a reader of some columns scans those,
    the key and the cursor. Only rows without a full key are told apart by their content, and only they are read for it.
    """
    both = extend_schema(target.schema, increment.schema)
    old, new = align(target, both), align(increment, both)
    full = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in key])
    marks = [F.col(f"`{k}`").alias(f"_t_{k}") for k in key]
    touched = new.filter(full).select(*marks, *([F.col(f"`{cursor}`").alias("_t_cursor")] if cursor else []))
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"`_t_{k}`") for k in key])
    winners = new.filter(full)
    if cursor:
        old_wins = F.coalesce(F.col(f"`{cursor}`") > F.col("_t_cursor"), F.col(f"`{cursor}`").isNotNull() & F.col("_t_cursor").isNull())
        met = old.filter(full).join(touched, same, "left")
        kept = met.filter(F.col(f"`_t_{key[0]}`").isNull() | old_wins).select(old.columns)
        beaten = old.filter(full).join(touched, same).filter(old_wins).select(*[F.col(f"`_t_{k}`") for k in key])
        winners = winners.join(beaten, same, "left_anti")
    else:
        kept = old.filter(full).join(touched, same, "left_anti")
    bare, more = (with_no_key(df.filter(~full), key) for df in (old, new))
    more = more.join(bare.select(F.col("_no_key").alias("_known")), F.col("_no_key") == F.col("_known"), "left_anti")
    return kept.unionByName(winners).unionByName(bare.unionByName(more).drop("_no_key"))


def fold(deltas: list[DataFrame], key: list[str], cursor: str | None = None) -> DataFrame:
    """Increments, oldest first, as one: the newest row per key, later increments win ties."""
    if len(deltas) == 1:
        return deltas[0]
    both = reduce(extend_schema, [d.schema for d in deltas])
    every = reduce(
        DataFrame.unionByName, [align(d, both).withColumn("_seq", F.lit(i)) for i, d in enumerate(deltas)]
    )
    order = [F.col(cursor).desc_nulls_last()] if cursor else []
    keyed = with_no_key(every, key, ignore=("_seq",))
    return newest(keyed, key, [*order, F.desc("_seq")]).drop("_no_key", "_seq")

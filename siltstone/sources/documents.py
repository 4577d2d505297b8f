"""Document collections: nested JSON, plain values, child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.values import iso_timestamp


def read_documents(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    after: str | None = None,
    key: str = "_id",
    multi_line: bool = False,
) -> DataFrame:
    """JSON documents, one per line or many per file; with ``after``, only those with a larger key."""
    reader = spark.read.option("multiLine", multi_line)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df if after is None else df.filter(F.col(key) > after)


def normalize_values(df: DataFrame) -> DataFrame:
    """Times as ISO-8601 text at any depth; structs, arrays and maps keep their shape."""
    return df.select(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _has_time(dt: T.DataType) -> bool:
    if isinstance(dt, T.StructType):
        return any(_has_time(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _has_time(dt.elementType)
    if isinstance(dt, T.MapType):
        return _has_time(dt.valueType)
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType))


def _plain(c: Column, dt: T.DataType) -> Column:
    if not _has_time(dt):
        return c
    if isinstance(dt, T.StructType):
        rebuilt = F.struct(*[_plain(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields])
        return F.when(c.isNotNull(), rebuilt)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _, v: _plain(v, dt.valueType))
    return iso_timestamp(c, isinstance(dt, T.TimestampType))


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns named ``outer__inner``."""

    def leaves(c: Column, name: str, dt: T.DataType) -> list[Column]:
        if not isinstance(dt, T.StructType):
            return [c.alias(name)]
        return [x for f in dt.fields for x in leaves(c.getField(f.name), f"{name}__{f.name}", f.dataType)]

    return df.select(*[x for f in df.schema.fields for x in leaves(F.col(f"`{f.name}`"), f.name, f.dataType)])


def unnest_children(df: DataFrame, table: str, key: str) -> dict[str, DataFrame]:
    """The flat parent table and one child table per list, at any depth.

    A child row has ``root_id`` (the document's key), ``parent_id``, ``list_idx`` and the element:
    its fields, or ``value`` for plain ones. Empty and missing lists have no rows. The children
    only refer to their row by position, so no shuffle is needed.
    """
    tables: dict[str, DataFrame] = {}
    top = df.select(F.col(key).cast("string").alias("_root"), F.col(key).cast("string").alias("_self"), "*")
    _split(top, table, tables, [])
    return tables


def _split(rows: DataFrame, table: str, tables: dict[str, DataFrame], carried: list[str]) -> None:
    helpers = {"_root", "_self"}
    flat = flatten(rows)
    lists = [f for f in flat.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name not in carried]
    tables[table] = flat.drop(*helpers, *[f.name for f in lists])
    for f in lists:
        items = flat.select(
            "_root", F.col("_self").alias("_parent"), F.posexplode(F.col(f"`{f.name}`")).alias("list_idx", "value")
        )
        content = ["value.*"] if isinstance(f.dataType.elementType, T.StructType) else ["value"]
        child = items.select(
            "_root",
            F.concat_ws("/", "_parent", "list_idx").alias("_self"),
            F.col("_root").alias("root_id"),
            F.col("_parent").alias("parent_id"),
            "list_idx",
            *content,
        )
        _split(child, f"{table}__{f.name}", tables, [])

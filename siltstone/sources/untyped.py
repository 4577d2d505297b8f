"""Documents of unknown shape: read as variants, types merged over all of them, then stored as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OBJECT = "map<string,variant>"
# What a path expression can spell between single quotes; other names go through a map.
_PLAIN_NAME = re.compile(r"[^'?]+")


def read(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(doc variant, rejected string) of JSON documents, one a line or, with ``whole_files``, one a file.

    A list at the top holds several documents, each a row. What is no object, or does not parse (a name twice in one
    object included), has a NULL ``doc`` and its text in ``rejected``; blank lines are left out.
    """
    lines = spark.read.text(path, wholetext=whole_files).filter(F.trim("value", F.lit(" \t\r\n")) != "")
    parsed = lines.select("value", F.try_parse_json("value").alias("doc"))
    listed = F.try_variant_get("doc", "$", "array<variant>")
    single = F.array(F.struct(F.col("doc").alias("doc"), F.col("value").alias("text")))
    several = F.transform(listed, lambda d: F.struct(d.alias("doc"), F.try_variant_get(d, "$", "string").alias("text")))
    each = parsed.select(F.inline(F.coalesce(several, single)))
    known = F.try_variant_get("doc", "$", _OBJECT).isNotNull()
    return each.select(F.when(known, F.col("doc")).alias("doc"), F.when(~F.coalesce(known, F.lit(False)), F.col("text")).alias("rejected"))


def merged_type(docs: DataFrame, column: str = "doc") -> T.StructType:
    """The type of all objects together, one aggregation that combines before its shuffle.

    A field has every name that any document has. Whole numbers and fractions widen; what has types that do not widen
    is VARIANT, and what is never more than JSON's null is VOID. The state grows with the number of different paths, so names must
    be names: objects keyed by ids belong into lists.
    """
    found = docs.agg(F.schema_of_variant_agg(F.col(column)).alias("found")).first().found
    if not found.startswith("OBJECT<"):
        return T.StructType([])
    # Names in backticks are passed over.
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m.group() == "OBJECT<" else m.group(), found)
    return T.StructType.fromDDL(f"doc {ddl}")[0].dataType


def shred(docs: DataFrame, shape: T.StructType, column: str = "doc") -> DataFrame:
    """The documents as columns: fields of objects named ``outer__inner``, lists as arrays, other columns kept in front.

    Values of mixed types are text: plain for one value, JSON for objects and lists; so are fields that are always null and
    objects that are always empty. A value that is missing or JSON's null is NULL. Names that agree but for their case, or
    with a name in front, get a number.
    """
    kept = [c for c in docs.columns if c != column]
    taken = {c.lower() for c in kept}

    def named(name: str) -> str:
        free, k = name, 2
        while free.lower() in taken:
            free, k = f"{name}__{k}", k + 1
        taken.add(free.lower())
        return free

    def leaves(value: Column, fields: list[T.StructField], before: str) -> list[Column]:
        found: list[Column] = []
        for f in fields:
            child = _child(value, f.name)
            if isinstance(f.dataType, T.StructType) and f.dataType.fields:
                found += leaves(child, f.dataType.fields, f"{before}{f.name}__")
            else:
                found.append(child.try_cast(_stored(f.dataType)).alias(named(before + f.name)))
        return found

    front = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
    return docs.select(*front, *leaves(F.col(column), shape.fields, ""))


def _child(value: Column, name: str) -> Column:
    if _PLAIN_NAME.fullmatch(name):
        return F.try_variant_get(value, f"$['{name}']", "variant")
    return F.element_at(F.try_variant_get(value, "$", _OBJECT), F.lit(name))


def _stored(dt: T.DataType) -> T.DataType:
    """The type with text for what has none of its own."""
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_stored(dt.elementType))
    if isinstance(dt, T.StructType) and dt.fields and len({f.name.lower() for f in dt.fields}) == len(dt.fields):
        return T.StructType([T.StructField(f.name, _stored(f.dataType)) for f in dt.fields])
    if isinstance(dt, (T.StructType, T.VariantType, T.NullType)):
        return T.StringType()
    return dt

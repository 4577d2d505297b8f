"""Schema changes between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.types import sql_name
from siltstone.session import small_frame

CHANGES = (
    "table_name string, column_name string, change_type string, old_type string, new_type string, requires_review boolean"
)
Change = tuple[str, str, str, str | None, str | None, bool]


class SchemaFrozen(ValueError):
    """A change that needs review met the ``freeze`` policy."""


def flatten(schema: T.StructType, prefix: str = "") -> dict[str, T.DataType]:
    """Leaf fields by dotted path; ``[]`` stands for the elements of an array."""
    leaves: dict[str, T.DataType] = {}
    for f in schema.fields:
        path, dt = f"{prefix}{f.name}", f.dataType
        while isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.StructType, T.ArrayType)):
            path, dt = f"{path}[]", dt.elementType
        if isinstance(dt, T.StructType):
            leaves |= flatten(dt, f"{path}.")
        else:
            leaves[path] = dt
    return leaves


def changes(old: T.StructType | None, new: T.StructType, table: str) -> list[Change]:
    """Added, removed and retyped fields in name order; nothing for a first version.

    Added fields are taken in; removed and retyped ones need review.
    """
    if old is None:
        return []
    before, after = flatten(old), flatten(new)
    found: list[Change] = []
    for path in sorted(before.keys() | after.keys()):
        was, now = before.get(path), after.get(path)
        if was is None:
            found.append((table, path, "column_added", None, sql_name(now), False))
        elif now is None:
            found.append((table, path, "column_removed", sql_name(was), None, True))
        elif was != now:
            found.append((table, path, "type_changed", sql_name(was), sql_name(now), True))
    return found


def check(old: T.StructType | None, new: T.StructType, table: str, policy: str = "evolve") -> list[Change]:
    """The changes, or an error under ``freeze`` if any needs review."""
    found = changes(old, new, table)
    blocked = [f"{c[1]} ({c[2]})" for c in found if c[5]]
    if policy == "freeze" and blocked:
        raise SchemaFrozen(f"{table}: {', '.join(blocked)}")
    return found


def detect(spark: SparkSession, old: T.StructType | None, new: T.StructType, table: str) -> DataFrame:
    """The changes as a frame."""
    return small_frame(spark, changes(old, new, table), CHANGES)


#: log2 of the entries of a column's sketch, and the resemblance (shared of all distinct values) from which it is the same column.
SKETCH_BITS = 12
RENAMED = 0.8


def column_values(df: DataFrame) -> DataFrame:
    """A bottom-k sketch of each column's distinct values as text, kept with a version: (column_name, type, sketch).

    One aggregation; columns of nested or binary type have none. What is equal as text is equal.
    """
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if not plain:
        return df.sparkSession.createDataFrame([], "column_name string, type string, sketch binary")
    cells = [F.struct(F.lit(f.name).alias("column_name"), F.lit(sql_name(f.dataType)).alias("type"),
                      F.theta_sketch_agg(F.col(f"`{f.name}`").cast("string"), SKETCH_BITS).alias("sketch")) for f in plain]
    one = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cells))])))


def renamed(old: DataFrame, new: DataFrame, least: float = RENAMED) -> DataFrame:
    """Removed columns that stand among the added ones under another name: (old_name, new_name, resemblance).

    ``old`` and ``new`` are the ``column_values`` of two versions. A removed and an added column of one type go together
    if their values resemble each other enough; each name is used once, the most alike first, then by name. Columns
    without values resemble nothing. The result is metadata, a row per pair of columns at most.
    """
    gone = old.join(new.select("column_name"), "column_name", "left_anti").withColumnsRenamed({"column_name": "old_name", "sketch": "_old"})
    added = new.join(old.select("column_name"), "column_name", "left_anti").withColumnsRenamed({"column_name": "new_name", "sketch": "_new"})
    shared = F.theta_sketch_estimate(F.theta_intersection("_old", "_new"))
    resemblance = shared / F.nullif(F.theta_sketch_estimate(F.theta_union("_old", "_new")), F.lit(0))
    pairs = gone.join(added, "type").select("old_name", "new_name", resemblance.alias("resemblance")).filter(F.col("resemblance") >= least)
    left, right, kept = set(), set(), []
    for r in sorted(pairs.collect(), key=lambda r: (-r["resemblance"], r["old_name"], r["new_name"])):
        if r["old_name"] not in left and r["new_name"] not in right:
            left.add(r["old_name"])
            right.add(r["new_name"])
            kept.append(tuple(r))
    return small_frame(old.sparkSession, kept, "old_name string, new_name string, resemblance double")

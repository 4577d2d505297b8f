"""Type names and type families used by model discovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN_NAMES = {
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.BinaryType: "BLOB",
}


def sql_name(dt: T.DataType) -> str:
    """ANSI-style name of a Spark type."""
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return f"{sql_name(dt.elementType)}[]"
    if isinstance(dt, T.StructType):
        inner = ", ".join(f'"{f.name}" {sql_name(f.dataType)}' for f in dt.fields)
        return f"STRUCT({inner})"
    if isinstance(dt, T.MapType):
        return f"MAP({sql_name(dt.keyType)}, {sql_name(dt.valueType)})"
    return _PLAIN_NAMES.get(type(dt), dt.simpleString().upper())


def family(dt: T.DataType) -> str:
    """integer, numeric, string, temporal, boolean or other, from the Spark type itself."""
    if isinstance(dt, T.IntegralType):
        return "integer"
    if isinstance(dt, (T.DecimalType, T.FractionalType)):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def family_of_name(name: Column) -> Column:
    """The same families for catalogs that only carry a type's name.

    Interval, array, map and struct names contain other type names and are tested first.
    """
    up = F.upper(name)
    return (
        F.when(up.rlike(r"^INTERVAL|\[\]$|^(ARRAY|MAP|STRUCT)\b"), "other")
        .when(up.rlike("INT"), "integer")
        .when(up.rlike("DECIMAL|NUMERIC|FLOAT|DOUBLE|REAL"), "numeric")
        .when(up.rlike("CHAR|TEXT|STRING|UUID"), "string")
        .when(up.rlike("DATE|TIME"), "temporal")
        .when(up.rlike("BOOL"), "boolean")
        .otherwise("other")
    )


def compatible(left: Column, right: Column) -> Column:
    """Families that can be compared without a cast."""
    both_numbers = left.isin("integer", "numeric") & right.isin("integer", "numeric")
    return F.coalesce((left == right) | both_numbers, F.lit(False))

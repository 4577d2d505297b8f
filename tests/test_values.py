from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siltstone.functions import values as V
from siltstone.functions.types import family, family_of_name, sql_name
from pyspark.sql import types as T


@pytest.mark.parametrize(
    "value, style, text",
    [
        (1234.0, "currency", "$1,234"),
        (1234.5, "currency", "$1,234.5"),
        (1234.56789, "number", "1,234.568"),
        (0.0, "number", "0"),
        (12.0, "percentage", "12%"),
        (12.5, "percentage", "12.5%"),
        (0.0, "compact", "0"),
        (950.4, "compact", "950"),
        (999.4, "compact", "999"),
        (999.5, "compact", "1K"),
        (1234.0, "compact", "1.2K"),
        (12345.0, "compact", "12K"),
        (999499.0, "compact", "999K"),
        (999500.0, "compact", "1M"),
        (1.5e9, "compact", "1.5B"),
        (-1234.0, "compact", "-1.2K"),
        (0.1234, "compact", "0.12"),
        (3725.0, "duration", "1h 2m"),
        (59.0, "duration", "0m"),
        (7200.0, "duration", "2h 0m"),
    ],
)
def test_formats(spark, value, style, text):
    got = spark.range(1).select(V.format_value(F.lit(value), style)).first()[0]
    assert got == text


def test_unknown_format():
    with pytest.raises(ValueError):
        V.format_value(F.lit(1), "roman")


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(V.safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0.0, 0.0, 0.0]


def test_plain_results_and_json_cells(spark):
    df = spark.createDataFrame(
        [(Decimal("1.50"), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 600), [1, 2])],
        "d decimal(10,2), t timestamp, n timestamp_ntz, l array<int>",
    )
    r = V.plain_results(df).first()
    assert (r.d, r.t, r.n) == (1.5, "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000600")
    assert V.json_cells(df).first().l == "[1,2]"


def test_type_families(spark):
    assert family(T.DecimalType(12, 2)) == "numeric" and family(T.ByteType()) == "integer"
    assert family(T.DayTimeIntervalType()) == "other" and family(T.TimestampNTZType()) == "temporal"
    assert sql_name(T.ArrayType(T.FloatType())) == "FLOAT[]"
    names = ["HUGEINT", "DECIMAL(12,2)", "VARCHAR", "UUID", "TIMESTAMP WITH TIME ZONE", "BOOLEAN", "INTERVAL", "INTEGER[]", "BLOB"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(family_of_name(F.col("n"))).collect()]
    assert got == ["integer", "numeric", "string", "string", "temporal", "boolean", "other", "other", "other"]

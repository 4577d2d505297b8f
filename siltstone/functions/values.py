"""Scalar helpers: exact money, safe ratios, labels, plain result values, display formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# JSON and CSV writers cut times to milliseconds unless told otherwise.
FULL_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def money(col: str | Column) -> Column:
    """Exact decimal of an amount in cents, so that sums do not depend on row order."""
    return _col(col).cast("decimal(18,2)")


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0 or either is NULL."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def month_label(ts: str | Column) -> Column:
    """``Jan 2024`` style label."""
    return F.date_format(_col(ts), "MMM yyyy")


def iso_timestamp(ts: Column, zoned: bool) -> Column:
    """ISO-8601 text; microseconds only where there are any, an offset only for zoned values."""
    offset = "xxx" if zoned else ""
    whole = F.date_format(ts, f"yyyy-MM-dd'T'HH:mm:ss{offset}")
    precise = F.date_format(ts, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{offset}")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(precise)


def plain_results(df: DataFrame) -> DataFrame:
    """Result columns as a client reads them: decimals as double, dates and times as ISO text."""

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_timestamp(c, isinstance(f.dataType, T.TimestampType))
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def json_cells(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            (F.to_json(F.col(f"`{f.name}`"), FULL_TIMES) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def format_value(value: Column, style: str) -> Column:
    """Display text of a number: currency, number, percentage, compact or duration."""
    v = value.cast("double")
    grouped = _pattern(F.round(v, 3), "#,##0.###")
    if style == "currency":
        return F.concat(F.lit("$"), grouped)
    if style == "number":
        return grouped
    if style == "percentage":
        return F.concat(_pattern(v, "0.###############"), F.lit("%"))
    if style == "compact":
        return _compact(v)
    if style == "duration":
        hours = F.floor(v / 3600).cast("string")
        minutes = F.floor((v % 3600) / 60).cast("string")
        return F.when(v >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m"))).otherwise(
            F.concat(minutes, F.lit("m"))
        )
    raise ValueError(f"unknown value format: {style}")


def _pattern(v: Column, pattern: str) -> Column:
    return F.call_function("format_number", v, F.lit(pattern))


def _compact(v: Column) -> Column:
    """Two significant digits below ten, whole numbers above, with K, M, B or T."""
    size = F.abs(v)
    text = F.lit(None).cast("string")
    for unit, suffix in ((1.0, ""), (1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        scaled = v / unit
        step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(scaled))) - 1)
        short = (
            F.when(scaled == 0, F.lit(0.0))
            .when(F.abs(scaled) < 9.95, F.round(scaled / step) * step)
            .otherwise(F.round(scaled))
        )
        piece = F.concat(_pattern(short, "#,##0.############"), F.lit(suffix))
        # 999.5 already shows as 1K, so each unit starts just below its round value.
        text = piece if unit == 1.0 else F.when(size >= unit * 0.9995, piece).otherwise(text)
    return text


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c

"""Widget results as CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.names import sanitize
from siltstone.functions.values import FULL_TIMES, json_cells
from siltstone.session import small_frame


def combine(widgets: dict[str, DataFrame]) -> DataFrame:
    """All rows under the union of all columns (first seen first), the widget's title in front.

    Array, map and struct cells become JSON text, and so do columns whose type differs between
    widgets.
    """
    frames = {title: json_cells(df) for title, df in widgets.items()}
    types: dict[str, set[str]] = {}
    for df in frames.values():
        for f in df.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {c for c, kinds in types.items() if len(kinds) > 1}
    result = None
    for title, df in frames.items():
        columns = [F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in df.columns]
        part = df.select(F.lit(title).alias("widget"), *columns)
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    if result is None:
        raise ValueError("nothing to export")
    return result


def to_csv(widgets: dict[str, DataFrame], path: str) -> dict[str, str]:
    """One CSV section per widget, each in a folder with its own header; returns the folders."""
    return _each(widgets, path, lambda df, out: json_cells(df).write.mode("overwrite").options(header=True, **FULL_TIMES).csv(out))


def to_json(widgets: dict[str, DataFrame], path: str) -> dict[str, str]:
    """One set of JSON lines per widget; NULL cells are kept."""
    return _each(
        widgets, path, lambda df, out: df.write.mode("overwrite").options(ignoreNullFields=False, **FULL_TIMES).json(out)
    )


def _each(widgets: dict[str, DataFrame], path: str, write) -> dict[str, str]:
    if not widgets:
        return {}
    spark = next(iter(widgets.values())).sparkSession
    titles = small_frame(spark, [(t,) for t in widgets], "title string")
    folders = {
        t: f"{path}/{i:02d}_{name}"
        for i, (t, name) in enumerate(titles.select("title", sanitize(F.col("title"))).collect())
    }
    for title, df in widgets.items():
        write(df, folders[title])
    return folders

"""Neighbours in time for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_next(
    df: DataFrame, key: str, ts: str, tiebreak: str, value: str, name: str, slice_unit: str = "day"
) -> DataFrame:
    """Add the ``value`` of each row's successor of the same key, ordered by (ts, tiebreak).

    A window over the key alone would put all rows of a hot key in one task. Here the window runs
    per key and time slice. The head of the key's next slice, found over one row per key and
    slice, is added to each slice as its last row, so the window sees it as a successor like any
    other. Heads come from a combining aggregation; the rows themselves are shuffled once.
    """
    rows = df.withColumns({"_slice": F.date_trunc(slice_unit, ts), "_end": F.lit(0)})
    heads = rows.groupBy(key, "_slice").agg(
        F.min_by(F.struct(F.col(value).alias("v")), F.struct(ts, tiebreak)).alias("_head")
    )
    later = F.lead("_head").over(Window.partitionBy(key).orderBy("_slice"))
    ends = heads.withColumn("_later", later).filter("_later IS NOT NULL").select(
        key, "_slice", F.lit(1).alias("_end"), F.col("_later.v").alias(value)
    )
    within = Window.partitionBy(key, "_slice").orderBy("_end", ts, tiebreak)
    return (
        rows.unionByName(ends, allowMissingColumns=True)
        .withColumn(name, F.lead(value).over(within))
        .filter("_end = 0")
        .select(*df.columns, name)
    )

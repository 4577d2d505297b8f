"""Column profiles that are kept per load and merged, so that a grown table is profiled from what is new.

Each segment leaves one row: for every column the number of values, the smallest and largest in the column's own type,
an HLL sketch of the distinct values and, for numbers, a KLL sketch of their order. Merging adds
counts, takes the smaller and larger ends and unites the sketches; it reads one row per segment and no data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.profile import _NESTED, _quoted
from siltstone.session import path_exists, union_all

#: log2 of the HLL registers: a standard error of 1.3 % (1.04 / sqrt(4096) is 1.6 % at the least favourable number).
HLL_BITS = 12
#: An estimate of distinct values lies within this share of the truth with a probability of over 99.9 %.
DISTINCT_BOUND = 0.06
#: Size of the KLL sketches; ranks of quantiles lie within this share of the rows with a probability of 99 %.
KLL_SIZE, RANK_BOUND = 400, 0.01


def summary(df: DataFrame) -> DataFrame:
    """One row about the rows of ``df``, in one aggregation."""
    columns = [F.count(F.lit(1)).alias("rows")]
    for f in df.schema.fields:
        c, name = F.col(_quoted(f.name)), f.name
        cells = [F.count(c).alias("present"), _distinct(c, f.dataType).alias("distinct")]
        if not isinstance(f.dataType, _NESTED):
            cells += [F.min(c).alias("low"), F.max(c).alias("high")]
        if isinstance(f.dataType, T.NumericType):
            cells.append(F.kll_sketch_agg_double(c.cast("double"), F.lit(KLL_SIZE)).alias("order"))
        columns.append(F.struct(*cells).alias(name))
    return df.agg(*columns)


def _distinct(c: Column, dt: T.DataType) -> Column:
    text = F.to_json(c) if isinstance(dt, _NESTED[:3]) else F.hex(c) if isinstance(dt, T.BinaryType) else c.cast("string")
    return F.hll_sketch_agg(text, F.lit(HLL_BITS))


def add(df: DataFrame, folder: str) -> None:
    """Profile a new segment and keep its row beside those of the others."""
    summary(df).withColumn("segment", F.lit(uuid.uuid4().hex)).coalesce(1).write.mode("append").parquet(folder)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The kept rows, one a segment; columns that a segment did not have are NULL."""
    if not path_exists(spark, folder):
        raise ValueError(f"no profile in {folder}")
    return spark.read.option("mergeSchema", True).parquet(folder)


def profile(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """The profile of all segments together: model, column_name, ordinal_position, row_count, cardinality (an estimate),
    null_percentage, min, max as text and, for numbers, the estimated median. Rows of segments without a column count as NULL there.
    """
    kept = segments(spark, folder)
    fields = [f for f in kept.schema.fields if f.name not in ("rows", "segment")]
    merged = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")]
    for i, f in enumerate(fields):
        inner = {g.name for g in f.dataType.fields}
        c = lambda part, f=f: F.col(f"{_quoted(f.name)}.{part}")
        merged += [F.coalesce(F.sum(c("present")), F.lit(0)).alias(f"n{i}"), F.hll_union_agg(c("distinct")).alias(f"d{i}")]
        merged += [(g(c(e)).cast("string") if e in inner else F.lit(None).cast("string")).alias(f"{e}{i}") for e, g in (("low", F.min), ("high", F.max))]
        merged.append((F.kll_merge_agg_double(c("order")) if "order" in inner else F.lit(None).cast("binary")).alias(f"k{i}"))
    one = kept.agg(*merged)
    parts = [
        one.select(
            F.lit(model).alias("model"),
            F.lit(f.name).alias("column_name"),
            F.lit(i + 1).alias("ordinal_position"),
            F.col("rows").alias("row_count"),
            F.coalesce(F.hll_sketch_estimate(f"d{i}"), F.lit(0)).alias("cardinality"),
            F.coalesce(F.round((F.col("rows") - F.col(f"n{i}")) / F.nullif("rows", F.lit(0)) * 100, 2), F.lit(0.0)).alias("null_percentage"),
            F.col(f"low{i}").alias("min"),
            F.col(f"high{i}").alias("max"),
            F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"k{i}", F.lit(0.5))).alias("median"),
        )
        for i, f in enumerate(fields)
    ]
    return union_all(parts)

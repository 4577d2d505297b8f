"""File sources: CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.values import FULL_TIMES

def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, key: bool = True, **options: str
) -> DataFrame:
    """CSV files with a header. Without a schema the types are inferred, which reads them twice.

    With ``key``, rows get a stable ``id`` if there is no such column.
    """
    reader = spark.read.option("header", True).options(**options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return ensure_key(df) if key and "id" not in df.columns else df


def ensure_key(df: DataFrame) -> DataFrame:
    """Add ``id`` to rows read from files: a hash of the content and its occurrence number.

    The same files always give the same ids, which random ids would not. Copies of a row are
    numbered per file block and shifted by the copies in earlier blocks, so a content that makes
    up much of the data is never brought together in one task.
    """
    content = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **FULL_TIMES}), 256)
    # Files of other systems do not expose a block start for every format; path and start suffice.
    rows = df.select(
        "*", content.alias("_c"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")
    )
    block = ["_c", "_f", "_b"]
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_c").orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*block).orderBy(F.lit(1))))
    ordinal = F.col("_r") + F.col("_before")
    return numbered.join(offsets, block).select(
        F.concat_ws("-", "_c", ordinal.cast("string")).alias("id"), *[F.col(f"`{c}`") for c in df.columns]
    )


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    """Schema of a file source: Parquet from a footer, CSV from inference over its rows."""
    return (read_csv(spark, path, key=False) if path.endswith(".csv") else read_parquet(spark, path)).schema

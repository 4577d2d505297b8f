"""Pages at any depth and the position of a row, by an index of row counts per range of the order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import path_exists

#: Rows a range holds on average: what a page reads.
RANGE_ROWS = 1_000_000
#: Rows that one task sorts on average, where ranges are smaller: it cuts them into many. What the driver gets (a sample
#: for the bounds and a result for each task) grows with the tasks, so small ranges must not be tasks of their own.
TASK_ROWS = 250_000
_RANGE = "__range"
#: monotonically_increasing_id() has the place of a row within its task in the lower 33 bits.
_PLACES = 1 << 33


def write(df: DataFrame, folder: str, order: list[str], descending: bool = False, range_rows: int = RANGE_ROWS) -> None:
    """Store rows by ranges of the order columns, and beside them the fences.

    One shuffle deals the rows to tasks by the order; each sorts its own and cuts them into one range or, where ranges
    are smaller than ``TASK_ROWS``, into several of ``range_rows`` rows. A range is one file. A fence has the range's
    number (rising, with gaps), its first and last order values, its rows, the rows before it and its files. NULLs come
    first (last if descending). The order should be total: rows that agree in all its columns may lie in neighbouring
    ranges, and the order among them is that of their files.
    """
    if path_exists(df.sparkSession, folder):
        raise ValueError(f"{folder} is there already")
    n = df.agg(F.count(F.lit(1))).first()[0]
    ranges = max(1, -(-n // range_rows))
    held = max(1, TASK_ROWS // range_rows)
    by = [F.desc(c) if descending else F.asc(c) for c in map(_quoted, order)]
    placed = F.monotonically_increasing_id()
    # A range's number is that of its first row; a task with one range has it from its own first row.
    number = placed - placed % _PLACES % range_rows if held > 1 else placed - placed % _PLACES
    dealt = df.repartitionByRange(-(-ranges // held), *by).sortWithinPartitions(*by).withColumn(_RANGE, number)
    # A file holds one range and nothing else; only its order columns are read again.
    dealt.write.option("maxRecordsPerFile", range_rows if held > 1 else 0).parquet(f"{folder}/rows")
    stored = df.sparkSession.read.schema(dealt.schema).parquet(f"{folder}/rows")
    values = F.struct(*[F.col(_quoted(c)).alias(f"v{i}") for i, c in enumerate(order)])
    least, most = (F.max, F.min) if descending else (F.min, F.max)
    fences = stored.groupBy(F.col(_RANGE).alias("range")).agg(
        least(values).alias("first"),
        most(values).alias("last"),
        F.count(F.lit(1)).alias("rows"),
        F.collect_set(F.col("_metadata.file_name")).alias("files"),
    )
    # One row a range.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    fences = fences.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    fences.withColumn("descending", F.lit(descending)).coalesce(1).write.parquet(f"{folder}/fences")


def fences(spark: SparkSession, folder: str) -> DataFrame:
    """(range, first, last, rows, files, before, descending), one row a range."""
    return spark.read.parquet(f"{folder}/fences")


def page(spark: SparkSession, folder: str, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the stored order; only the ranges that hold them are opened.

    Its cost depends on the page and a range's size, not on the depth: whole ranges in front are skipped by their counts.
    An offset behind the last row gives no rows.
    """
    held = (F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)
    found = fences(spark, folder).filter(held).orderBy("range").select("before", "files", "descending").collect()
    if not found:
        return spark.read.parquet(f"{folder}/rows").drop(_RANGE).limit(0)
    rows = _open(spark, folder, [f for r in found for f in r.files])
    # Equal rows of two ranges keep the order of these.
    ordered = rows.orderBy(_RANGE, *[F.desc(c) if found[0].descending else F.asc(c) for c in map(_quoted, order)])
    skipped = offset - found[0].before
    return (ordered.offset(skipped) if skipped else ordered).limit(limit).drop(_RANGE)


def position(spark: SparkSession, folder: str, order: list[str], values: tuple) -> DataFrame:
    """One row (position): how many stored rows come before the given order values, whether a row has these or not.

    The fences in front count as a whole; the one range where rows ahead of the values end is read.
    """
    index = fences(spark, folder)
    top = index.orderBy("range").select("descending").head()
    if top is None:
        return spark.range(1).select(F.lit(0).cast("long").alias("position"))
    types = index.schema["first"].dataType.fields
    at = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, types)])
    # Rows with just these values may go on over several ranges; all that come before lie up to the last that starts ahead.
    started = index.filter(_ahead(F.col("first"), at, top.descending))
    last = started.orderBy(F.desc("range")).select("before", "files").head()
    if last is None:
        return spark.range(1).select(F.lit(0).cast("long").alias("position"))
    own = F.struct(*[F.col(_quoted(c)).alias(f.name) for c, f in zip(order, types)])
    rows = _open(spark, folder, last.files).filter(_ahead(own, at, top.descending))
    return rows.agg((F.count(F.lit(1)) + last.before).alias("position"))


def _ahead(a: Column, b: Column, descending: bool) -> Column:
    return a > b if descending else a < b


def _open(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{folder}/rows/{f}" for f in files])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

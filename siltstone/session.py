"""Session settings, metadata frames and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL_WORK: set[str] = set()


def build_session(app: str = "siltstone", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings every operator assumes.

    Shuffle width is a deployment choice, so it is only set when the caller passes it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call sites of column expressions cost more than building the expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def small_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A driver-made frame of metadata (schemas, parameters, reports).

    Going through Arrow makes it a local relation whose size Catalyst knows, so a join with
    it is broadcast only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = pa.table(
        {
            f.name: pa.array(list(values), type=_arrow_type(f.dataType))
            for f, values in zip(schema.fields, columns)
        }
    )
    return spark.createDataFrame(arrow, schema=schema)


def pin(df: DataFrame) -> DataFrame:
    """Compute a metadata frame (rows per column, per pair of columns) once, as a local relation.

    Never for table rows: the result passes through the driver.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


_ARROW = {
    T.StringType: pa.string(),
    T.BooleanType: pa.bool_(),
    T.IntegerType: pa.int32(),
    T.LongType: pa.int64(),
    T.DoubleType: pa.float64(),
    T.DateType: pa.date32(),
    T.TimestampType: pa.timestamp("us", tz="UTC"),
    T.TimestampNTZType: pa.timestamp("us"),
}


def _arrow_type(dt: T.DataType) -> pa.DataType:
    if isinstance(dt, T.ArrayType):
        return pa.list_(_arrow_type(dt.elementType))
    return _ARROW[type(dt)]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, on whatever file system its URL names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by position, built as a balanced tree so that analysis does not grow with the square."""
    while len(frames) > 1:
        frames = [a.union(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) // 2 * 2 :]
    return frames[0]


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written tables and streaming state.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Where that is unset a local
    master gets a folder beside its warehouse, which is removed when the process ends; on a cluster it is an
    error, because the executors could not see a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        beside = "/" + spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:").strip("/")
        root = f"{beside}-work/{spark.sparkContext.applicationId}"
        if root not in _LOCAL_WORK:
            _LOCAL_WORK.add(root)
            atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

"""Files that tasks write to the shared work folder and read back.

A task writes each file under a name of its own attempt and hands its row to a manifest that Spark commits.
A file of a failed or repeated attempt is in no manifest, so it is never read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def _at(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url)


@contextmanager
def new_file(folder: str, suffix: str):
    """An output stream and the path of a new file in the folder."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    system, inner = _at(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        yield out, path


def open_file(path: str):
    """A file for reading at any place."""
    system, inner = _at(path)
    return system.open_input_file(inner)


def committed(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Run the writing tasks, keep their rows as the manifest and return it."""
    rows.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def spread(manifest: DataFrame) -> DataFrame:
    """The manifest with about a file per task; a manifest has a row per file."""
    return manifest.repartition(max(1, min(manifest.count(), 20_000)))

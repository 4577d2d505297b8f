"""Archives of CSV and Parquet files as a data source: a partition an archive, its members streamed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows a task holds before it hands them on.
BATCH_ROWS = 4096
#: Bytes of the compressed archive read at a time.
READ_BYTES = 1 << 20


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class ArchiveSource(DataSource):
    """``archives``: (archive, member, cells) of the ``.tar.gz`` files in the folder ``path``.

    Options: ``path``; ``names``, a JSON list of the wanted columns; ``first_only``, whether only the first member by name
    is read. Cells are texts in the order of the names: those of a CSV row by place, the header left out, those of a
    Parquet row by name.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, member string, cells array<string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        import json

        first_only = self.options.get("first_only", "false").lower() == "true"
        return ArchiveReader(self.options["path"], json.loads(self.options["names"]), first_only)


class ArchiveReader(DataSourceReader):
    """Lists the folder once, then every task opens one archive from its start and decompresses it as it goes.

    Neither the archive nor a CSV member is ever held whole. Parquet keeps its directory at the end, so a Parquet
    member is held while it is read.
    """

    def __init__(self, folder: str, names: list[str], first_only: bool) -> None:
        self.folder, self.names, self.first_only = folder.rstrip("/"), names, first_only

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        system, at = _place(self.folder)
        found = system.get_file_info(fs.FileSelector(at))
        names = sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".tar.gz"))
        return [Archive(f"{self.folder}/{n}") for n in names]

    def read(self, partition: Archive) -> Iterator:
        import pyarrow as pa

        if partition is None:  # no archive in the folder
            return
        wanted = None
        if self.first_only:
            wanted = min((m.name for m, _ in _members(partition.value)), default=None)
        for member, stream in _members(partition.value):
            if wanted not in (None, member.name):
                continue
            parse = self._csv_rows if member.name.lower().endswith(".csv") else self._parquet_rows
            for rows in _batches(parse(stream)):
                held = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.value] * held, pa.string()),
                        pa.array([member.name] * held, pa.string()),
                        pa.array(rows, pa.list_(pa.string())),
                    ],
                    names=["archive", "member", "cells"],
                )
            if wanted is not None:
                return

    def _csv_rows(self, stream) -> Iterator[list]:
        import csv
        import io

        n = len(self.names)
        csv.field_size_limit(2**31 - 1)
        found = csv.reader(io.TextIOWrapper(stream, "utf-8", newline=""))
        next(found, None)
        for row in found:
            if row:
                yield [c or None for c in row[:n]] + [None] * (n - len(row))

    def _parquet_rows(self, stream) -> Iterator[list]:
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        found = pq.ParquetFile(io.BytesIO(stream.read()))
        have = set(found.schema_arrow.names)
        for batch in found.iter_batches(BATCH_ROWS, columns=[n for n in self.names if n in have]):
            none = [None] * batch.num_rows
            cells = [batch.column(n).cast(pa.string()).to_pylist() if n in have else none for n in self.names]
            yield from (list(r) for r in zip(*cells))


def _place(uri: str) -> tuple:
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _members(uri: str) -> Iterator[tuple]:
    """The CSV and Parquet members in their order, each to be read before the next is asked for.

    An archive that is cut off or damaged raises; its checksum is tested when its last member has been read.
    """
    import gzip
    import tarfile

    system, at = _place(uri)
    with system.open_input_stream(at, compression=None, buffer_size=READ_BYTES) as raw:
        with gzip.GzipFile(fileobj=raw) as plain, tarfile.open(fileobj=plain, mode="r|", bufsize=READ_BYTES) as tar:
            tar.fileobj.seekable = lambda: False  # text readers ask, and the stream has no answer of its own
            for member in tar:
                if member.isfile() and member.name.lower().endswith((".csv", ".parquet")):
                    yield member, tar.extractfile(member)
                tar.members.clear()  # a stream never goes back to them
            while plain.read(READ_BYTES):
                pass


def _batches(rows: Iterator[list]) -> Iterator[list]:
    from itertools import islice

    while batch := list(islice(rows, BATCH_ROWS)):
        yield batch


def read_archives(spark: SparkSession, folder: str, schema: str, first_only: bool = False) -> DataFrame:
    """Rows of the CSV and Parquet members of a folder's ``.tar.gz`` files in the given schema, with archive and member.

    All members are read unless only the first by name is asked for, as a single upload has one. CSV cells may
    hold quoted line breaks; an empty cell and one that does not fit its type are NULL. An archive is compressed as a
    whole and cannot be split, so each is one task's work, and different archives run in parallel.
    """
    import json

    spark.dataSource.register(ArchiveSource)
    fields = T.StructType.fromDDL(schema).fields
    names = json.dumps([f.name for f in fields])
    cells = spark.read.format("archives").options(path=folder, names=names, first_only=str(first_only).lower()).load()
    typed = [F.col("cells")[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
    return cells.select("archive", "member", *typed)

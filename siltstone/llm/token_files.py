"""Token ids of documents in files of packed 64-bit words, in ascending document order.

A file is: the mark ``IDS8``; the blocks of packed words, each followed by its escaped values; an index with
the block table (place, ids, words, escaped values), the document ids, whether each is null and the number of
ids of each; and a tail of the index's place, length and CRC-32 and the mark again. All numbers are
little-endian. Any block is found through the table and decoded by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import shared_files, tokens
from siltstone.llm.word_packing import BLOCK, pack, unpack
from siltstone.session import work_dir

MARK = b"IDS8"
TAIL = struct.Struct("<QQI4s")
#: Ids after which a file is closed; a file holds whole documents.
FILE_IDS = 4_000_000
#: Characters of a text by which rows of one id are dealt to tasks.
RANGE_CHARS = 64


def write_file(out, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
    """One file of documents and all their ids."""
    out.write(MARK)
    at, blocks = len(MARK), []
    for k in range(0, len(ids), BLOCK):
        part = ids[k : k + BLOCK]
        words, escaped = pack(part.astype(np.uint64))
        out.write(words.tobytes())
        out.write(escaped.tobytes())
        blocks.append((at, len(part), len(words), len(escaped)))
        at += 8 * (len(words) + len(escaped))
    index = b"".join(
        [
            struct.pack("<QQ", len(blocks), len(doc_ids)),
            np.array(blocks, np.uint64).tobytes(),
            doc_ids.astype(np.int64).tobytes(),
            nulls.astype(np.uint8).tobytes(),
            counts.astype(np.uint64).tobytes(),
        ]
    )
    out.write(index)
    out.write(TAIL.pack(at, len(index), zlib.crc32(index), MARK))


def read_index(f) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block table, document ids, null flags and counts; raises if the file is not whole."""
    size = f.size()
    if size < len(MARK) + TAIL.size or f.read_at(len(MARK), 0) != MARK:
        raise ValueError("not a token file")
    at, length, crc, mark = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
    index = f.read_at(length, at) if mark == MARK and at + length + TAIL.size == size else b""
    if zlib.crc32(index) != crc or not index:
        raise ValueError("token file with a broken index")
    n_blocks, n_docs = struct.unpack_from("<QQ", index)
    table, rest = index[16 : 16 + 32 * n_blocks], index[16 + 32 * n_blocks :]
    return (
        np.frombuffer(table, np.uint64).reshape(-1, 4).astype(np.int64),
        np.frombuffer(rest[: 8 * n_docs], np.int64),
        np.frombuffer(rest[8 * n_docs : 9 * n_docs], np.uint8).astype(bool),
        np.frombuffer(rest[9 * n_docs :], np.uint64).astype(np.int64),
    )


def read_block(f, row: np.ndarray) -> np.ndarray:
    at, n, words, escaped = (int(x) for x in row)
    raw = np.frombuffer(f.read_at(8 * (words + escaped), at), np.uint64)
    return unpack(raw[:words], raw[words:], n)


def write_ids(
    spark: SparkSession, docs: DataFrame, path: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write files in ascending order of the document id.

    Returns the manifest: part, file, path, n_docs, n_ids. Null text is empty, null ids come first, rows that
    repeat an id follow each other by text. The texts are dealt out by ranges of the id, so no task sorts more
    than its share; rows that repeat an id are dealt by the beginnings of their texts, of which only equal ones share a task.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, file = tokens.encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            with shared_files.new_file(f"{folder}/files", ".ids8") as (out, name):
                write_file(out, *columns)
            row = [part, file, name, len(columns[0]), len(columns[3])]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["part", "file", "path", "n_docs", "n_ids"],
            )

        for batch in batches:
            for rows in tokens.slices(batch, "__text"):
                ids, counts = tokens.with_end(*encoder.encode(rows.column("__text")), end_id)
                key = rows.column("__doc")
                held.append((key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), counts, ids))
                size += len(ids)
                if size >= FILE_IDS:
                    yield close()
                    held, size, file = [], 0, file + 1
        if held:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).cast("string").alias("__text"))
    # A prefix orders texts as they do themselves, and is all that goes into the sample of the ranges.
    ranged = rows.repartitionByRange(F.col("__doc"), F.substring("__text", 1, RANGE_CHARS))
    ordered = ranged.sortWithinPartitions("__doc", "__text")
    schema = "part int, file int, path string, n_docs long, n_ids long"
    return shared_files.committed(spark, ordered.mapInArrow(written, schema), folder)


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    Each file's start is the running sum of the manifest's counts, which has a row per file.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with shared_files.open_file(name) as f:
                    blocks, docs, nulls, counts = read_index(f)
                    ids = np.concatenate([np.empty(0, np.uint32), *(read_block(f, b).astype(np.uint32) for b in blocks)])
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array(docs, mask=nulls), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(np.concatenate(([0], ends)), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                for k in range(0, whole.num_rows, 5000):
                    yield whole.slice(k, 5000)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shared_files.spread(placed).mapInArrow(read, schema)


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the ids of the documents to a fresh folder of the shared work folder and read them back."""
    return read_ids(write_ids(spark, docs, path, end_id, work_dir(spark, "token-ids")))

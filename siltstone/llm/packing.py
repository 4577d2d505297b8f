"""Packing of token pieces into sequences of fixed length, from the histogram of their lengths.

Documents are cut into full sequences and one rest. Lengths are placed longest first, each into the packing
pattern with the most room (the shortest pack), by counts alone: the work on the driver depends on the
sequence length, not on the number of pieces. The patterns are then joined back to the pieces by each
piece's rank among the pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import tokens
from siltstone.session import small_frame, work_dir

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every document (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens and, if asked, ids.

    Null text is the end id alone. ``ids`` are little-endian 32-bit integers.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                ids, counts = tokens.with_end(*encoder.encode(rows.column("text")), end_id)
                per_doc = -(-counts // capacity)
                of = np.repeat(np.arange(len(counts)), per_doc)
                first = np.cumsum(per_doc) - per_doc
                start = (np.arange(len(of)) - first[of]) * capacity
                length = np.minimum(counts[of] - start, capacity)
                at = (np.cumsum(counts) - counts)[of] + start
                raw = ids.tobytes()
                view = memoryview(raw)
                parts = [view[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
                columns = [
                    rows.column("doc_id").take(pa.array(of)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(counts[of]),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns and how many sequences use each, by shortest pack first over the lengths."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # What this length fills is not offered to it again before all other rooms that hold it.
        room = capacity
        while left:
            while room >= length and not open_[room]:
                room -= 1
            if room < length:
                open_[capacity - length].append((left, (length,)))
                if capacity - length < length or left == 1:
                    break
                # A pattern of this length alone has room for more of it: fold it upon itself.
                n, _ = open_[capacity - length].pop()
                fits = capacity // length
                if n >= fits:
                    open_[capacity - fits * length].append((n // fits, (length,) * fits))
                if n % fits:
                    open_[capacity - n % fits * length].append((1, (length,) * (n % fits)))
                break
            n, pack = open_[room].pop()
            used = min(n, left)
            if n > used:
                open_[room].append((n - used, pack))
            open_[room - length].append((used, (*pack, length)))
            left -= used
    return [(n, pack) for room in sorted(open_) for n, pack in open_[room]]


def slots(spark: SparkSession, packs: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """Where the pieces of each length go: ranks ``lo`` up to ``hi`` go to sequences ``first`` onwards at ``offset``."""
    rank: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for n, pack in packs:
        offset = 0
        for length in pack:
            rows.append((length, rank[length], rank[length] + n, first, offset))
            rank[length] += n
            offset += length
        first += n
    return small_frame(spark, rows, "slot_length long, lo long, hi long, first long, offset long")


def with_rank(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds the rank of each piece among those of its length, from 0.

    Every length is dealt into as many buckets as the root of its number of pieces, which are numbered by themselves; a
    bucket starts where the counts of those before it end. So of n pieces of a length, which may be a third of all, a
    bucket holds about the root of n, and so many buckets are put in order.
    """
    spark = pieces.sparkSession
    # One row a length, of which there are as many as a sequence holds ids at most.
    wanted = small_frame(spark, [(length, math.isqrt(n - 1) + 1) for length, n in histogram.items()], "of_length long, buckets long")
    dealt = pieces.join(F.broadcast(wanted), F.col("length") == F.col("of_length")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets"))
    ).drop("of_length", "buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    numbered = dealt.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth")).drop("bucket", "base", "nth")


def place(spark: SparkSession, pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset; ``pieces`` is read three times, so it should be a written table.

    The slots are at most a few for each pair of lengths whatever the number of pieces, so they are broadcast.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(spark, patterns(histogram, capacity))
    ranked = with_rank(pieces, histogram)
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(where), fits)
    return placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("lo")).drop(
        "slot_length", "lo", "hi", "first", "rank"
    )


def assemble(placed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids (little-endian 32-bit) of pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", "n_tokens", ids.alias("ids"))


def pack_documents(
    spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, with_ids: bool = False
) -> DataFrame:
    """All pieces of all documents with their sequence and offset.

    Rows that repeat an id are packed as documents of their own; null text is the end id alone; an empty
    table gives no pieces. Columns other than doc_id and text are not looked at.
    """
    folder = work_dir(spark, "pieces")
    cut_documents(docs, path, end_id, capacity, with_ids).write.parquet(folder)
    return place(spark, spark.read.parquet(folder), capacity)

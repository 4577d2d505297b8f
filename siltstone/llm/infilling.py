"""Fill-in-the-middle documents over a store of seekable compressed frames.

A text is a run of units, each a word with the blanks before it (blanks at the end are a unit of their own). A
store file holds the texts of many documents one after the other as independent zstandard frames of whole
units, an index with the number of units, bytes and characters before every frame, and the place of every
document. A cut after so many units is found by a binary search in the index and decompresses one frame. The
transformed text is then a list of marks and byte ranges of the store; it is streamed frame by frame, and
the original is rebuilt from that stream alone.

A file is: the mark ``FIM1``; the frames; the index, itself a frame; and a tail of the index's place and length
and the mark again. All numbers are little-endian.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import shared_files, tokens, words
from siltstone.session import work_dir

MARK = b"FIM1"
TAIL = struct.Struct("<QQ4s")
#: Bytes of text after which a frame is closed at the next unit's end; a longer unit is a frame of its own.
FRAME_BYTES = 65_536
#: Bytes of text after which a store file is closed; a file holds whole documents.
FILE_BYTES = 32_000_000
LEVEL = 3

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents so many are transformed, and of a hundred of those so many begin with the suffix.
FIM_PERCENT, SPM_PERCENT = 50, 80
SEED = "42"


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where each unit of a text's UTF-8 bytes ends."""
    if not len(raw):
        return np.empty(0, np.int64)
    blank = words.BLANKS[raw]
    return np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, len(raw))


def n_chars(raw: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


class _Writer:
    """Collects frames of one file."""

    def __init__(self, out):
        self.out, self.at = out, len(MARK)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.held_bytes, self.units, self.bytes = [], 0, 0, 0
        self.frames: list[tuple] = []  # place, length, units before, bytes before
        self.docs: list[tuple] = []  # id, null, units before, units, bytes before, bytes, marked
        out.write(MARK)

    def close_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            first_unit, first_byte = self._opened
            self.frames.append((self.at, len(packed), first_unit, first_byte))
            self.at += len(packed)
            self.held, self.held_bytes = [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        raw = np.frombuffer(text, np.uint8)
        ends = unit_ends(raw)
        marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
        self.docs.append((doc_id or 0, doc_id is None, self.units, len(ends), self.bytes, len(text), marked))
        done = 0
        while done < len(ends):
            start = int(ends[done - 1]) if done else 0
            if not self.held:
                self._opened = (self.units, self.bytes)
            stop = max(done + 1, int(np.searchsorted(ends, start + FRAME_BYTES - self.held_bytes, side="right")))
            end = int(ends[stop - 1])
            self.held.append(text[start:end])
            self.held_bytes += end - start
            self.units += stop - done
            self.bytes += end - start
            done = stop
            if self.held_bytes >= FRAME_BYTES or done < len(ends):
                self.close_frame()

    def close(self) -> None:
        self.close_frame()
        docs = list(zip(*self.docs))
        index = struct.pack("<QQ", len(self.frames), len(self.docs)) + np.array(self.frames, np.int64).tobytes()
        index += b"".join(np.array(c, np.int64).tobytes() for c in docs)
        packed = self.packer.compress(index)
        self.out.write(packed)
        self.out.write(TAIL.pack(self.at, len(packed), MARK))


def write_store(spark: SparkSession, docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the texts to store files; returns the manifest (path, n_docs). Null text counts as empty."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = (
            (i, (t.as_buffer().to_pybytes() if t.is_valid else b""))
            for batch in batches
            for rows in tokens.slices(batch, "__text")
            for i, t in zip(rows.column("__doc").to_pylist(), rows.column("__text").cast(pa.large_binary()))
        )
        row = next(pending, None)
        while row is not None:
            with shared_files.new_file(f"{folder}/store", ".fim") as (out, path):
                file = _Writer(out)
                while row is not None and file.bytes < FILE_BYTES:
                    file.add(*row)
                    row = next(pending, None)
                file.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(file.docs)], pa.int64())], ["path", "n_docs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).cast("string").alias("__text"))
    return shared_files.committed(spark, rows.mapInArrow(written, "path string, n_docs long"), folder)


class Store:
    """Random access to one store file; holds the index and the frame that was read last."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        at, length, mark = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size)) if size >= TAIL.size else (0, 0, b"")
        if mark != MARK or at + length + TAIL.size != size:
            raise ValueError("not a store of frames")
        self.unpacker = zstandard.ZstdDecompressor()
        index = self.unpacker.decompress(f.read_at(length, at))
        n_frames, n_docs = struct.unpack_from("<QQ", index)
        numbers = np.frombuffer(index[16:], np.int64)
        self.frames = numbers[: 4 * n_frames].reshape(-1, 4)
        self.docs = numbers[4 * n_frames :].reshape(-1, n_docs).T if n_docs else np.empty((0, 7), np.int64)
        self.units, self.starts = np.ascontiguousarray(self.frames[:, 2]), np.ascontiguousarray(self.frames[:, 3])
        self.last = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, length = int(self.frames[k, 0]), int(self.frames[k, 1])
            self.last = (k, self.unpacker.decompress(self.f.read_at(length, at)))
            self.last_ends = None
        return self.last[1]

    def byte_of(self, unit: int, end: int) -> int:
        """The file's byte at which its unit number ``unit`` begins; ``end`` is the byte after the document."""
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        raw = self.frame(k)
        if self.last_ends is None:
            self.last_ends = self._ends(k, raw)
        inner = unit - int(self.units[k])
        return min(end, int(self.starts[k]) + (int(self.last_ends[inner - 1]) if inner else 0))

    def _ends(self, k: int, raw: bytes) -> np.ndarray:
        """Where the units of a frame end; a document's end ends a unit too."""
        ends = unit_ends(np.frombuffer(raw, np.uint8))
        first = int(self.starts[k])
        borders = self.docs[:, 4] + self.docs[:, 5] - first
        inside = borders[np.searchsorted(borders, 1) : np.searchsorted(borders, len(raw), side="right")]
        return np.union1d(ends, inside)

    def read(self, lo: int, hi: int) -> Iterator[bytes]:
        """The bytes from lo to hi, frame by frame."""
        k = int(np.searchsorted(self.starts, lo, side="right")) - 1
        while lo < hi:
            raw, first = self.frame(k), int(self.starts[k])
            part = raw[lo - first : hi - first]
            yield part
            lo, k = lo + len(part), k + 1


class Output:
    """A transformed text: marks and byte ranges of the store in order."""

    def __init__(self, store: Store, parts: list[bytes | tuple[int, int]]):
        self.store, self.parts = store, parts

    def read(self, lo: int = 0, hi: int | None = None) -> Iterator[bytes]:
        """The output's bytes from lo to hi (default: all), frame by frame."""
        at = 0
        for p in self.parts:
            size = len(p) if isinstance(p, bytes) else p[1] - p[0]
            a, b = max(lo - at, 0), size if hi is None else min(hi - at, size)
            if a < b:
                if isinstance(p, bytes):
                    yield p[a:b]
                else:
                    yield from self.store.read(p[0] + a, p[0] + b)
            at += size


def find_marks(chunks: Iterator[bytes]) -> tuple[dict[bytes, int], int]:
    """Where each mark first stands in a stream, and the stream's length."""
    found: dict[bytes, int] = {}
    at, tail = 0, b""
    for chunk in chunks:
        near = tail + chunk
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in found and (k := near.find(mark)) >= 0:
                found[mark] = at - len(tail) + k
        at += len(chunk)
        tail = near[-2:]
    return found, at


def restored(output: Output, form: str) -> Iterator[bytes]:
    """The original text of an output, from its marks alone: prefix, middle, suffix.

    No original that is transformed holds a mark, and no mark arises where marks and text meet, so the first of each is the one that was set.
    """
    if form == "plain":
        yield from output.read()
        return
    marks, size = find_marks(output.read())
    order = sorted(marks, key=marks.get)
    pieces = {m: (marks[m] + len(m), marks[after] if after else size) for m, after in zip(order, [*order[1:], None])}
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(*pieces[m])


def drawn(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers of a document from the first four groups of its hash."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def _transformed(store: Store, row: np.ndarray, fim_percent: int, spm_percent: int, seed: str):
    """A document of the store: id, units, form, characters of prefix and middle, and output."""
    doc, null, unit0, n, lo, size, marked = (int(v) for v in row)
    hi = lo + size
    h1, h2, h3, h4 = drawn(None if null else doc, seed)
    if not size or marked or h3 % 100 >= fim_percent:
        return n, "plain", None, None, Output(store, [(lo, hi)])
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = store.byte_of(unit0 + a, hi) if a < n else hi
    second = store.byte_of(unit0 + b, hi) if b < n else hi
    count = lambda x, y: sum(n_chars(np.frombuffer(c, np.uint8)) for c in store.read(x, y))
    prefix, middle, suffix = (lo, first), (first, second), (second, hi)
    if h4 % 100 < spm_percent:
        form, parts = "spm", [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]
    else:
        form, parts = "psm", [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]
    return n, form, count(*prefix), count(*middle), Output(store, parts)


def _digest(chunks: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def read_store(
    manifest: DataFrame, with_output: bool = False, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED
) -> DataFrame:
    """Every document of the store transformed: doc_id, n, form, prefix_chars, middle_chars, the digests of the output
    and of the text rebuilt from it, and, if asked, the output itself (only then a text is held whole).

    The numbers that decide form and cuts are drawn from seed and id, so rows that repeat an id are treated alike;
    rows without an id share the numbers of an empty one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        width = len(names) if with_output else len(names) - 1

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names[:width])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with shared_files.open_file(path) as f:
                    store, rows, size = Store(f), [], 0
                    for row in store.docs:
                        n, form, prefix, middle, output = _transformed(store, row, fim_percent, spm_percent, seed)
                        out = [None if row[1] else int(row[0]), n, form, prefix, middle, _digest(output.read()), _digest(restored(output, form))]
                        if with_output:
                            out.append(b"".join(output.read()).decode())
                            size += int(row[5])
                        rows.append(tuple(out))
                        if len(rows) >= 5000 or size >= tokens.SLICE_BYTES:
                            yield made(rows)
                            rows, size = [], 0
                    if rows:
                        yield made(rows)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return shared_files.spread(manifest).mapInArrow(read, schema + ", output string" * with_output)


def fill_in_middle(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_output: bool = False) -> DataFrame:
    """The documents transformed, over a store in a fresh folder of the shared work folder; one row per row."""
    return read_store(write_store(spark, docs, work_dir(spark, "frames"), doc_id, text), with_output)

"""Web archives: WARC 1.1 records, one Zstandard frame each, with a dictionary in front of every file.

A file begins with a skippable frame (number 0x184D2A5D) that holds the dictionary, itself compressed or not.
Every record is one frame compressed with it. The reader walks the frames by their block headers, decodes one
frame at a time and checks versions, header lines, lengths, closing line breaks and digests, so a file of any
size takes the memory of its largest record.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import shared_files, tokens
from siltstone.session import work_dir

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: A file is closed when it has reached so many bytes.
FILE_BYTES = 64_000_000
#: The dictionary of a file is trained on its first records, up to these many bytes of them.
SAMPLE_BYTES = 1_000_000
DICTIONARY_BYTES = 32_768
#: Largest record that a reader accepts, so that a false length cannot take all memory: more than any payload that fits
#: a cell of a table (2 GiB) with its headers, so every record that can be written is read back.
MAX_RECORD = (1 << 31) + (1 << 24)

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class BrokenArchive(ValueError):
    """What is wrong, in which file and at which byte."""


@dataclass
class Record:
    """A record's headers in order (names in lower case) and its block."""

    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and body of the HTTP message in the block."""
        head, mark, body = self.block.partition(b"\r\n\r\n")
        lines = head.decode("latin-1").split("\r\n")
        if not mark or not lines[0].startswith("HTTP/"):
            raise ValueError("no HTTP message in the block")
        return _fields(lines[1:]), body


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, mark, value = line.partition(":")
        if not mark or not name or name != name.strip() or name.lower() in out:
            raise ValueError(f"header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Record:
    """The one record of a decoded frame; raises ValueError if anything is amiss."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError("no WARC version line")
    headers = _fields([x.decode() for x in lines[1:]])
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in headers]
    if missing:
        raise ValueError(f"without {', '.join(missing)}")
    if not re.fullmatch(r"[0-9]{1,18}", headers["content-length"]):
        raise ValueError(f"length {headers['content-length'][:40]!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {length} bytes and two line breaks announced, {len(rest)} bytes there")
    record = Record(headers, rest[:length])
    if digest := headers.get("warc-block-digest"):
        if digest != "sha1:" + hashlib.sha1(record.block).hexdigest():
            raise ValueError("block digest differs")
    return record


class Writer:
    """Writes records to an open stream; the dictionary comes from the records that arrive first."""

    def __init__(self, out, sample: list[bytes]):
        self.out, self.size = out, 0
        content = _dictionary(sample)
        frame = zstandard.ZstdCompressor(level=3).compress(content) if content else b""
        self._write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
        made = zstandard.ZstdCompressionDict(content) if content else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True, write_content_size=True)

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def record(self, raw: bytes) -> None:
        self._write(self.compressor.compress(raw))


def _dictionary(sample: list[bytes]) -> bytes:
    """A trained dictionary, or the sample's beginning where there is too little to train on."""
    if sum(map(len, sample)) >= 8 * DICTIONARY_BYTES and len(sample) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(sample)[:DICTIONARY_BYTES]


class Reader:
    """The records of an archive, read through ``read(n)``."""

    def __init__(self, read, name: str = ""):
        self.read, self.name, self.at = read, name, 0
        self.dictionary = None

    def _take(self, n: int) -> bytes:
        parts = []
        while n:
            part = self.read(n)
            if not part:
                raise BrokenArchive(f"{self.name}: ends inside a frame at byte {self.at}")
            parts.append(bytes(part))
            self.at += len(part)
            n -= len(part)
        return b"".join(parts)

    def _frame(self, mark: bytes) -> bytes:
        """The rest of a frame after its first four bytes, found by the sizes of its blocks."""
        parts = [mark, self._take(1)]
        flags = parts[1][0]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        size = (1 if single else 0, 2, 4, 8)[flags >> 6]
        parts.append(self._take((not single) + (0, 1, 2, 4)[flags & 3] + size))
        while True:
            head = self._take(3)
            value = int.from_bytes(head, "little")
            kind, n = value >> 1 & 3, value >> 3
            if kind == 3:
                raise BrokenArchive(f"{self.name}: reserved block at byte {self.at - 3}")
            parts += [head, self._take(1 if kind == 1 else n)]
            if value & 1:
                return b"".join([*parts, self._take(4 * checksum)])

    def __iter__(self) -> Iterator[Record]:
        first = True
        while start := self.read(1):
            begin = self.at
            self.at += 1
            mark = bytes(start) + self._take(3)
            number = struct.unpack("<I", mark)[0]
            if number == SKIPPABLE and first:
                content = self._take(struct.unpack("<I", self._take(4))[0])
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 24)
                self.dictionary = zstandard.ZstdCompressionDict(content) if content else None
            elif number & 0xFFFFFFF0 == 0x184D2A50:
                self._take(struct.unpack("<I", self._take(4))[0])
            elif number == FRAME:
                frame = self._frame(mark)
                try:
                    yield parse(self._decoded(frame))
                except (ValueError, zstandard.ZstdError) as e:
                    raise BrokenArchive(f"{self.name}: record at byte {begin}: {e}") from e
            else:
                raise BrokenArchive(f"{self.name}: no frame at byte {begin}")
            first = False

    def _decoded(self, frame: bytes) -> bytes:
        announced = zstandard.get_frame_parameters(frame).content_size
        if announced not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR) and announced > MAX_RECORD:
            raise ValueError(f"{announced} bytes announced")
        made = zstandard.ZstdDecompressor(dict_data=self.dictionary) if self.dictionary else zstandard.ZstdDecompressor()
        return made.decompress(frame, max_output_size=MAX_RECORD if announced == zstandard.CONTENTSIZE_UNKNOWN else 0)


def _record(page: int | None, url: str | None, payload: bytes, digest: str, leader: int | None) -> bytes:
    """A page as a record: a response, or a revisit whose HTTP head alone is kept."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    safe = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "")
    headers = [
        ("WARC-Type", "response" if leader is None else "revisit"),
        ("WARC-Record-ID", _name(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", safe or _name(page)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if leader is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(leader))]
    block = http if leader is not None else http + payload
    headers.append(("WARC-Block-Digest", "sha1:" + hashlib.sha1(block).hexdigest()))
    return serialise(headers, block)


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def with_leaders(pages: DataFrame, payload: Column) -> DataFrame:
    """Adds ``__leader``: for a page whose payload another page stores, that page's id.

    Pages meet by digest with ids only; the payloads are joined by page id, which no group shares. Digests held
    once are dropped before the join, and the digests' largest ids are combined in each task first.
    """
    sized = pages.select(F.col("page_id").alias("__page"), F.sha1(payload).alias("__digest"), F.octet_length(payload).alias("__size"))
    sized = sized.where((F.col("__size") >= REVISIT_BYTES) & F.col("__page").isNotNull())
    leaders = (
        sized.groupBy(F.col("__digest").alias("__d")).agg(F.max("__page").alias("__leader"), F.min("__page").alias("__low")).where("__low < __leader")
    )
    others = sized.join(leaders, F.col("__digest") == F.col("__d")).where("__page < __leader").select("__page", "__digest", "__leader").distinct()
    same = (F.col("page_id") == F.col("__page")) & (F.sha1(payload) == F.col("__digest"))
    return pages.join(others, same, "left").drop("__page", "__digest")


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """A record for every page (page_id, url, html); returns the manifest (path, n_records, n_bytes).

    Null html is the empty payload, null urls and ids give records named after nothing. Rows that repeat an id
    have records of their own; those that share the group's largest id and its payload are all responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    led = with_leaders(rows, F.col("html").cast("binary")).select("page_id", "url", "__leader", "html")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, n, size in _files(batches, folder, file_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"]
            )

    return shared_files.committed(spark, led.mapInArrow(written, "path string, n_records long, n_bytes long"), folder)


def _files(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[tuple[str, int, int]]:
    """Write all records of a task to files of about ``file_bytes``."""

    def records() -> Iterator[bytes]:
        for batch in batches:
            for part in tokens.slices(batch, "html"):
                for page, url, leader, html in zip(*(c.to_pylist() for c in part.columns)):
                    payload = html.encode("utf-8", "surrogatepass")
                    yield _record(page, url, payload, hashlib.sha1(payload).hexdigest(), leader)

    left = records()
    held: list[bytes] = []
    while True:
        size = sum(map(len, held))
        while size < min(SAMPLE_BYTES, file_bytes) and (raw := next(left, None)) is not None:
            held.append(raw)
            size += len(raw)
        if not held:
            return
        n = 0
        with shared_files.new_file(f"{folder}/archives", ".warc.zst") as (out, name):
            # A record longer than the sample would be the dictionary; its beginning is enough.
            writer = Writer(out, [r[:SAMPLE_BYTES] for r in held])
            while held or writer.size < file_bytes:
                raw = held.pop(0) if held else next(left, None)
                if raw is None:
                    break
                writer.record(raw)
                n += 1
        yield name, n, writer.size


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all files: page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits).

    Anything that is not as it should be raises, with the file and the byte. A revisit's payload length is
    the one that its HTTP head states; a response's length and digest are compared with its payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                rows, size, seen = [], 0, 0
                with shared_files.open_file(name) as f:
                    # Frames are read in small steps, files in large ones.
                    whole = pa.BufferedInputStream(f, 1 << 20)
                    for record in Reader(whole.read, name):
                        rows.append(_row(record, name))
                        size += len(record.block)
                        seen += 1
                        if size > tokens.SLICE_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                if seen != n:
                    raise BrokenArchive(f"{name}: {seen} records, {n} were written")
                if rows:
                    yield _batch(rows)

    return shared_files.spread(manifest).mapInArrow(read, RECORDS)


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _row(record: Record, name: str) -> tuple:
    h = record.headers
    try:
        http, body = record.http()
        length = int(http.get("content-length", "-1"))
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = h["warc-type"]
        if kind == "response" and (length != len(body) or digest != hashlib.sha1(body).hexdigest()):
            raise ValueError("payload differs from its length or digest")
        if kind == "revisit" and (body or length < 0 or "warc-refers-to" not in h):
            raise ValueError("revisit with a payload, without a length or without what it refers to")
    except ValueError as e:
        raise BrokenArchive(f"{name}: {h['warc-record-id']}: {e}") from e
    refers = _page(h.get("warc-refers-to")) if kind == "revisit" else None
    return _page(h["warc-record-id"]), h.get("warc-target-uri"), kind, refers, length, digest, body if kind == "response" else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to archives in a fresh folder of the shared work folder and read them back."""
    return read_archives(write_archives(spark, pages, work_dir(spark, "archives")))

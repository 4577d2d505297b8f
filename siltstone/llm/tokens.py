"""Token ids of whole texts, by the tokenizers library, at the speed of distinct words.

Both vocabularies used here cut a text into pieces that never reach across a change from
non-blank to blank, so a text is split at those changes (in Arrow), each distinct chunk of a slice is
encoded once and the ids are gathered back (in numpy). The shortcut holds for texts of printable ASCII
and Latin-1 letters without the mark ``<|`` of special strings; every other text goes through the
library's own ``encode_batch_fast`` as a whole or in pieces cut at safe places.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the memory of a task.
SLICE_BYTES = 8_000_000
#: Bytes of text given to the library at once, and the length beyond which a text is cut.
BATCH_BYTES = 1_000_000
LONG_BYTES = 65_536
#: Pieces a worker remembers; when full it starts anew.
MEMO = 400_000

_UPPER = "A-ZÀ-ÖØ-Þ"
_LOWER = "a-zß-öø-ÿ"
_SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")
_ENCODERS: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies name each byte: itself if printable, else 256 and up."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts under one vocabulary file, the same as the library's without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = self.library.model
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        self.lower, self.odd, self.pieces = False, None, None
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        kind = _layout(spec)
        if kind == "bytes":
            letters = _UPPER + _LOWER
            self.odd = rf"[^\n -~{letters}]|<\|"
            self.pieces = re.compile(
                rf"{contractions}| ?[{letters}]+| ?[0-9]+| ?[^\s{letters}0-9]+|\s+(?!\S)|\s+"
            ).findall
        elif kind == "words":
            self.lower = True
            self.odd = rf"[^\t\n\r -~{_UPPER}{_LOWER}]|<\|"
            self.pieces = re.compile(rf"{contractions}|[{_LOWER}]+|[0-9]|[^\s{_LOWER}0-9]+").findall

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and each text's number of ids. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.odd is None:
            return self._by_library(texts.to_pylist())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        ids, counts = self._by_chunk(plain)
        if odd.any():
            more, more_counts = self._by_library(texts.filter(pa.array(odd)).to_pylist())
            ids, counts = _interleave(ids, counts, more, more_counts, odd)
        return ids, counts

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Each text's number of ids; no ids are kept. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.odd is None:
            return self._counts_by_library(texts.to_pylist())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        chunks = self._chunks(plain)
        distinct = chunks.flatten().dictionary_encode()
        known = self._chunk_counts(distinct.dictionary.to_pylist())
        upto = np.concatenate(([0], np.cumsum(known[distinct.indices.to_numpy(zero_copy_only=False)])))
        bounds = chunks.offsets.to_numpy()
        counts = np.diff(upto[bounds - bounds[0]])
        if odd.any():
            counts[odd] = self._counts_by_library(texts.filter(pa.array(odd)).to_pylist())
        return counts

    def _chunk_counts(self, chunks: list[str]) -> np.ndarray:
        """The numbers of ids of distinct chunks; those not yet known are encoded in batches of about equal bytes."""
        if len(self.sizes) > MEMO:
            self.sizes.clear()
        sizes = self.sizes
        new = [c for c in chunks if c not in sizes]
        for batch in balanced([len(c.encode()) for c in new]):
            encoded = self.library.encode_batch_fast([new[k] for k in batch], add_special_tokens=False)
            for k, e in zip(batch, encoded):
                sizes[new[k]] = len(e.ids)
        return np.fromiter(map(sizes.__getitem__, chunks), np.int64, len(chunks))

    def _counts_by_library(self, texts: list[str]) -> np.ndarray:
        """Texts as they are; long ones in pieces, in batches of about equal bytes."""
        parts = [(i, p) for i, text in enumerate(texts) for p in cut(text)]
        counts = np.zeros(len(texts), np.int64)
        for batch in balanced([len(p.encode()) for _, p in parts]):
            encoded = self.library.encode_batch_fast([parts[k][1] for k in batch], add_special_tokens=False)
            for k, e in zip(batch, encoded):
                counts[parts[k][0]] += len(e.ids)
        return counts

    def _chunks(self, texts: pa.Array) -> pa.Array:
        """The texts as lists of chunks that no id reaches across."""
        if self.lower:
            return pc.ascii_split_whitespace(pc.utf8_lower(texts))
        return pc.split_pattern(pc.replace_substring_regex(texts, r"([ \n]+)", "\x1f\\1"), "\x1f")

    def _by_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = self._chunks(texts)
        distinct = chunks.flatten().dictionary_encode()
        where = distinct.indices.to_numpy(zero_copy_only=False)
        found = self._remember(distinct.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), np.uint32)
        starts = np.cumsum(lengths) - lengths
        per_chunk = lengths[where]
        ends = np.cumsum(per_chunk)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[where] - (ends - per_chunk), per_chunk) + np.arange(total)]
        bounds = chunks.offsets.to_numpy()
        bounds = np.concatenate(([0], ends))[bounds - bounds[0]]
        return ids, np.diff(bounds)

    def _remember(self, chunks: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, pieces = self.memo, self.pieces
        out = []
        for chunk in chunks:
            known = memo.get(chunk)
            if known is None:
                parts = [chunk] if self.lower and chunk.isalpha() else pieces(chunk)
                if len(parts) == 1 and parts[0] == chunk:
                    known = memo[chunk] = self._piece(chunk)
                else:
                    known = b""
                    for part in parts:
                        ids = memo.get(part)
                        if ids is None:
                            ids = memo[part] = self._piece(part)
                        known += ids
            out.append(known)
        return out

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable() and " " not in piece):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts as they are; long ones in pieces, in batches of about equal bytes."""
        parts: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            parts.extend((i, p) for p in cut(text))
        found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(parts)
        for batch in balanced([len(p.encode()) for _, p in parts]):
            encoded = self.library.encode_batch_fast([parts[k][1] for k in batch], add_special_tokens=False)
            for k, e in zip(batch, encoded):
                found[k] = np.array(e.ids, np.uint32)
        counts = np.zeros(len(texts), np.int64)
        for (i, _), ids in zip(parts, found):
            counts[i] += len(ids)
        return np.concatenate([np.empty(0, np.uint32), *found]), counts


def _layout(spec: dict) -> str:
    """Whether the file is one of the two layouts for which chunks can be encoded alone."""
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")
    special = all(t["content"].startswith("<|") and not t["normalized"] for t in spec.get("added_tokens") or [])
    if not plain or not special:
        return ""
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
    cuts = [p["type"] for p in pre.get("pretokenizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"]:
        pattern = pre["pretokenizers"][0]["pattern"].get("Regex", "")
        if pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return "words"
    return ""


def cut(text: str) -> list[str]:
    """A long text in pieces that end before a single blank between a letter or digit and a letter.

    No token of either layout reaches across such a place. A text without one stays whole.
    """
    if len(text) <= LONG_BYTES:
        return [text]
    out, start = [], 0
    while len(text) - start > LONG_BYTES:
        at = _SAFE_CUT.search(text, start + LONG_BYTES // 2)
        if not at:
            break
        out.append(text[start : at.start()])
        start = at.start()
    return [*out, text[start:]]


def balanced(sizes: list[int]) -> Iterator[list[int]]:
    """Indices in batches of at most ``BATCH_BYTES`` (or one text), longest first."""
    batch, held = [], 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if batch and held + sizes[k] > BATCH_BYTES:
            yield batch
            batch, held = [], 0
        batch.append(k)
        held += sizes[k]
    if batch:
        yield batch


def _interleave(ids, counts, more, more_counts, odd) -> tuple[np.ndarray, np.ndarray]:
    """Both sets of ids in the order of the texts."""
    counts = counts.copy()
    counts[odd] = more_counts
    of_odd = np.repeat(odd, counts)
    out = np.empty(len(ids) + len(more), np.uint32)
    out[of_odd] = more
    out[~of_odd] = ids
    return out, counts


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's, and the counts with it."""
    counts = counts + 1
    last = np.zeros(int(counts.sum()), bool)
    last[np.cumsum(counts) - 1] = True
    out = np.empty(len(last), np.uint32)
    out[last] = end_id
    out[~last] = ids
    return out, counts


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``SLICE_BYTES`` of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop

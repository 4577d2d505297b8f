"""Words of many texts at once as 64-bit hashes, on the bytes of an Arrow column (numpy).

A word's hash is a polynomial over its bytes, each first replaced by a fixed random number, taken from running
sums of the whole buffer; the length is mixed in. All arithmetic wraps at 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20_240_611)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}

#: Bytes between words: space and the five ASCII control blanks.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words of letters, digits left out as well: all of ASCII but letters.
NOT_LETTERS = np.zeros(256, bool)
NOT_LETTERS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Bytes hashed at once, or one word if it is longer.
RUN_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a known hash)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(which: str, n: int) -> np.ndarray:
    have = _POWERS[which]
    if len(have) < n:
        step = np.full(max(n, RUN_BYTES), _BASE if which == "base" else _INVERSE, np.uint64)
        step[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(step)
    return have[:n]


def hashed(texts: pa.Array, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one after the other, and where each text's begin (one more than texts).

    A-Z is lower-cased; null has no words.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if texts.null_count:
        # A null's bytes, if it has any, are no words.
        gone = np.repeat(np.asarray(texts.is_null()), np.diff(offsets))
        raw = np.where(gone, np.uint8(0x20), raw)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~between[_LOWER[raw]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # A text's first byte begins a word even if the text before ends in one.
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    words = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + RUN_BYTES, side="right")))
        begin, end = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[raw[begin:end]]] * _powers("base", end - begin), out=sums[1:])
        at = starts[i:j] - begin
        words[i:j] = (sums[ends[i:j] - begin] - sums[at]) * _powers("inverse", end - begin)[at]
        i = j
    words = mix(words + mix((ends - starts).astype(np.uint64)))
    return words, np.searchsorted(starts, offsets).astype(np.int64)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words by its first word, runs across texts included; the last size-1 are left out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = mix(h * _BASE + words[k : k + n])
    return h

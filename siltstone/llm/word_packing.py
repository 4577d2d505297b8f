"""Simple-8b: as many small integers as fit, packed into each 64-bit word.

The upper four bits of a word select a packing: how many values the other 60 bits hold and how wide each
is. Selector 0 escapes a value of more than 60 bits: the word's payload is its place in the block's list of
escaped values, so that every word of a block can be read by its selector alone.
"""

from __future__ import annotations

import numpy as np

#: Values in a word by selector 1 to 14, and the bits of each.
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // n for n in PER_WORD)
#: Values packed at once; every block can be decoded alone.
BLOCK = 65_536

_COUNT = np.array([1, *PER_WORD, 0], np.int64)
_SELECTOR = np.zeros(61, np.uint64)
_SELECTOR[list(PER_WORD)] = np.arange(1, 15)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, at least 1."""
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    return np.maximum(bits, 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block as words and escaped values. The last word may hold padding zeros; the count is kept elsewhere."""
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    padded = np.zeros(n + 60, np.uint64)
    padded[:n] = values
    widths = _widths(padded)
    # The widest value among the next c, for growing c, each from two smaller windows.
    window, most = {1: widths}, np.ones(n, np.uint8)
    for c, bits in sorted(zip(PER_WORD, BITS)):
        if c > 1:
            a = max(k for k in window if k < c)
            b = max(k for k in window if k <= c - a)
            w = window[a].copy()
            rest = window[b][c - b :]
            w[: len(rest)] = np.maximum(w[: len(rest)], rest)
            window[c] = w
        most = np.where(window[c][:n] <= bits, np.uint8(c), most)
    escaped = widths[:n] > 60
    step = most.tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    start = np.array(starts, np.int64)
    size = most[start].astype(np.int64)
    is_escape = escaped[start]
    words = np.where(is_escape, np.uint64(0), _SELECTOR[size] << np.uint64(60))
    for c, bits in zip(PER_WORD, BITS):
        of = np.flatnonzero((size == c) & ~is_escape)
        if len(of):
            at = start[of]
            word = words[of]
            for k in range(c):
                word |= padded[at + k] << np.uint64(k * bits)
            words[of] = word
    out = padded[start[is_escape]]
    words[is_escape] = np.arange(len(out), dtype=np.uint64)
    return words, out


def unpack(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The block's values, each selector's words at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selector]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        of = np.flatnonzero(selector == s)
        if s == 0:
            out[start[of]] = escaped[(words[of] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        c, bits = PER_WORD[s - 1], BITS[s - 1]
        mask = np.uint64((1 << bits) - 1)
        for k in range(c):
            out[start[of] + k] = (words[of] >> np.uint64(k * bits)) & mask
    return out[:n]

"""Words of whole texts as arrays: byte scans over Arrow columns in slices of bounded size.

Words are named by 64-bit hashes: a polynomial over random byte values, modulo 2^64, then mixed. Two
different words share a name with a probability of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes that one round of array work holds; the arrays take about 60 times as much.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


class Words:
    """Finds words by a table of word bytes; A-Z become a-z."""

    BASE = 0x9E3779B97F4A7C55

    def __init__(self, is_word: np.ndarray) -> None:
        self.is_word = is_word
        values = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
        values[65:91] = values[97:123]
        self.values = values
        self.powers = np.ones(1, U64)
        self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) >= n:
            return
        n = max(n, 1 << 16)
        for name, base in (("powers", self.BASE), ("inverses", _inverse(self.BASE))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and text number of every word, in order."""
        n = len(data)
        if n == 0:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        inside = self.is_word[data]
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(offsets, starts, side="right") - 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U64))


def white_space() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of runs of rows of about ``limit`` bytes; nulls are empty.

    A longer text is a run of its own, never cut.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last

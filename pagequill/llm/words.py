"""Words and word windows of many texts at once, as numpy arrays over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WHITE = b" \t\n\x0b\x0c\r"
BYTE_PRIME = 0x9E3779B97F4A7C15
WORD_PRIME = 0xC2B2AE3D27D4EB4F
OTHER_PRIME = 0xA0761D6478BD642F
SLICE = 2 << 20


class Texts:
    """Rows ``lo`` to ``hi`` of a batch: their bytes in one buffer, and the bounds of each text in it."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        self.lo, self.hi, self.data, self.bounds = lo, hi, data, bounds


def texts(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[Texts]:
    """The texts of a column in pieces of about ``size`` bytes; a text is never cut. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        yield Texts(lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


def word_table(separators: bytes = WHITE) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


IS_WORD = word_table()


class Words:
    """Byte bounds of the words of some texts; ``first[i]`` is the index of the first word of text ``i``."""

    def __init__(self, part: Texts, table: np.ndarray = IS_WORD):
        inside = table[part.data]
        edges = part.bounds[:-1][np.diff(part.bounds) > 0]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[edges] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[edges[1:] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, part.bounds)
        self.counts = np.diff(self.first)
        self.data = part.data

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def places(self) -> np.ndarray:
        """Each word's number in its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self) -> np.ndarray:
        sums = prefix(self.data, BYTE_PRIME, 1)
        return mix((sums[self.ends] - sums[self.starts]) * power_at(inverse(BYTE_PRIME), self.starts))


def inverse(prime: int) -> int:
    return pow(prime, -1, 1 << 64)


#: Powers are products of two small tables, the exponent's low bits and its high ones: nothing kept grows with a text.
LOW_BITS = 12
STRIDE = 1 << 18


@lru_cache(16)
def _table(prime: int, n: int) -> np.ndarray:
    out = np.full(n, prime, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(prime: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    high = 1 << max(8, (n >> LOW_BITS).bit_length())
    return _table(prime, 1 << LOW_BITS), _table(pow(prime, 1 << LOW_BITS, 1 << 64), high)


def power_at(prime: int, at: np.ndarray) -> np.ndarray:
    """prime ** at, modulo 2 ** 64."""
    low, high = _tables(prime, int(at.max()) if len(at) else 0)
    return low[at & ((1 << LOW_BITS) - 1)] * high[at >> LOW_BITS]


def powers(prime: int, stop: int, start: int = 0) -> np.ndarray:
    """prime ** i for i from ``start``, a multiple of the low table's size."""
    low, high = _tables(prime, stop)
    return (high[start >> LOW_BITS : (stop >> LOW_BITS) + 1, None] * low).reshape(-1)[: stop - start]


def prefix(values: np.ndarray, prime: int, plus: int = 0) -> np.ndarray:
    """Sums of (value[i] + plus) * prime ** i, modulo 2 ** 64, before each place. Taken in strides: a long text costs its sums alone."""
    out = np.zeros(len(values) + 1, np.uint64)
    for lo in range(0, len(values), STRIDE):
        hi = min(len(values), lo + STRIDE)
        sums = out[lo + 1 : hi + 1]
        np.cumsum((values[lo:hi].astype(np.uint64) + np.uint64(plus)) * powers(prime, hi, lo), out=sums)
        sums += out[lo]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, prime: int = WORD_PRIME) -> np.ndarray:
    """A hash of each run of ``size`` words, by its first word. Runs over the end of a text are the caller's to leave out."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    sums = prefix(words, prime)
    return mix((sums[size:] - sums[:-size]) * powers(inverse(prime), len(sums) - size))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text row of every shingle. A text of fewer words, but one at least, is one shingle as a whole."""
    hashes = words.hashes()
    spans = window_hashes(hashes, size)
    keep = (words.places() + size <= np.repeat(words.counts, words.counts))[: len(spans)]
    out, rows = spans[keep], words.rows()[: len(spans)][keep]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.array([window_hashes(hashes[words.first[i] : words.first[i + 1]], int(words.counts[i]))[0] for i in short], np.uint64)
        out, rows = np.concatenate([out, whole]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows

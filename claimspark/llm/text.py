"""Arrow text columns as flat arrays: slices of bounded size, words and their hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once. A single longer text is a slice of its own.
SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.arange(256)
#: Bytes of `[^\x20\x09-\x0D]+`.
SPACED = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and everything beyond ASCII.
ALNUM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n - 1, kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut so that the texts of a slice have ``most`` bytes or are one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


@dataclass
class Words:
    """Words of a few texts in order: byte places in ``data``, the row each is in, and rows' first words."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row, n + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def sums(self) -> np.ndarray:
        """Running sums of a polynomial in the bytes, from which the hash of any stretch follows."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(len(self.data) + 1)[0][:-1], out=sums[1:])
        return sums

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes; the cost is per byte."""
        return self.hashes_of(self.start, self.end)

    def hashes_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        return mix((self.sums[end] - self.sums[start]) * powers(len(self.data) + 1)[1][start])

    def text(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode()


def words(column: pa.Array, inside: np.ndarray, fold: bool = True) -> Words:
    """Maximal runs of ``inside`` bytes in each text, A-Z lower-cased unless ``fold`` is off."""
    raw, offsets = flat(column)
    data = LOWER[raw] if fold else raw
    on = np.zeros(len(data) + 2, bool)
    on[1:-1] = inside[data]
    begins = on[1:-1] & ~on[:-2]
    ends = on[1:-1] & ~on[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = on[1:-1][cuts]
    ends[cuts - 1] = on[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, first)


def word_hash(word: str) -> np.uint64:
    return words(pa.array([word]), np.ones(256, bool)).hashes()[0]

"""Reading Arrow batches of texts in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (one text that is longer makes a slice of its own).
SLICE = 1 << 20


#: The C library's own, where it has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give the system what is free here: a worker lives on beside others after its task."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in order; a batch is let go before the next is asked for."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column_at = batch.column(column)
        width = np.frombuffer(column_at.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column_at.type) else np.int32)[column_at.offset : column_at.offset + len(column_at) + 1].astype(np.int64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(width, width[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
        del batch, column_at, width
    release()


class Texts:
    """The texts of a slice as one byte array, words and all, without Python objects.

    data: bytes; offsets: where each text starts, and the end; starts, ends: of the
    words, which are runs of bytes that are not ASCII white space; first: the number of
    the first word of each text, and the number of words.  Null texts have no bytes.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = pa.compute.fill_null(column, "")
        at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data, self.offsets = (LOWER[data] if lower else data), at - at[0]
        inside = ~SPACE[self.data]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        cuts = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[cuts] = False
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[cuts[1:] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def prefix(self) -> np.ndarray:
        """Sums of byte times power, from which span() takes the hash of any span."""
        up, _ = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        return total

    def span(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes of each span: equal spans, equal hashes."""
        _, down = powers(len(self.data) + 1)
        return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * LENGTH)

    def words(self) -> np.ndarray:
        return self.span(self.prefix(), self.starts, self.ends)


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        grown = np.ones((2, max(n, SLICE + 4096)), np.uint64)
        for row, base in zip(grown, (BASE, INVERSE)):
            row[1:] = base
            np.cumprod(row, out=row)
        _powers[:] = list(grown)
    return _powers[0], _powers[1]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x

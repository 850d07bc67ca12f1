"""Texts as numpy arrays: byte buffers of Arrow columns, words, and hashes of
words, word windows and byte windows, all computed for a whole slice of rows at
once. Memory is a small multiple of the slice, whose size the callers bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 2 << 20


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(column, most: int = SLICE_BYTES):
    """Row ranges (start, stop) of at most ``most`` bytes, one row at least."""
    n = len(column)
    _, off = utf8(column)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def byte_class(excluded: str | None = None, included=None) -> np.ndarray:
    """Table byte -> bool."""
    table = np.full(256, included is None, bool)
    for b in (excluded or "").encode():
        table[b] = False
    for b in included or ():
        table[b] = True
    return table


#: Bytes of words [^\x20\x09-\x0D]+ (all bytes of a multi-byte character are in).
NOT_BLANK = byte_class("\x20\x09\x0a\x0b\x0c\x0d")


@dataclass
class Words:
    """Words of a slice: byte ranges and the range of word indexes per row."""
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray      # offsets into start/end, one more than rows

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.row)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), self.count)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_BLANK) -> Words:
    """Maximal runs of bytes in ``table``; runs never cross rows."""
    inside = table[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(off), np.int64))
    full = off[:-1][np.diff(off) > 0]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[full] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[full[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, off))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that every bit depends on all input bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Rolling:
    """Polynomial hash modulo 2**64 of ranges of a sequence, from prefix sums.
    The base is odd, so a prefix is shifted back by its inverse power."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.byte = rng.integers(0, 1 << 63, 256, np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(1 << 61, 1 << 62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                    for b in (self.base, self.inverse))
        return self.up, self.down

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair (unmixed)."""
        up, down = self._powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=total[1:])
        return (total[end] - total[start]) * down[start]

    def of_words(self, data: np.ndarray, w: Words) -> np.ndarray:
        h = self.ranges(self.byte[data], w.start, w.end)
        return mix(h ^ ((w.end - w.start).astype(np.uint64) * U64(0x9E3779B97F4A7C15)))

    def windows(self, values: np.ndarray, size: int) -> np.ndarray:
        """Hash of values[i:i+size] for i in 0 .. len - size."""
        n = len(values) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = self._powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=total[1:])
        return mix((total[size:] - total[:-size]) * down[:n])


def window_starts(row: np.ndarray, size: int) -> np.ndarray:
    """True for i where a window of ``size`` items from i stays within its row;
    row: offsets of rows into the items. As long as Rolling.windows' result."""
    n = int(row[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    mark = np.zeros(int(row[-1]) + 1, np.int32)
    lo, hi = row[:-1], np.maximum(row[1:] - size + 1, row[:-1])
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi, -1)
    return np.cumsum(mark)[:n] > 0


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of n items, those in a range of ``size`` from any of ``starts``."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + size, n), -1)
    return np.cumsum(mark[:-1]) > 0


def per_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sum of values within each row's range of offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[row[1:]] - total[row[:-1]]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

"""Vectorised scanning of Arrow text columns: words and their hashes, without a per-word loop.

All functions work on one slice of rows at a time (see :func:`slices`), so a task's
memory is bounded by the slice size or by its longest single text, never by the partition.
Words are maximal runs of bytes outside a set of ASCII separators, which is safe in UTF-8.

Hashes are 64-bit polynomial prefix hashes with a final mix.  They name words and windows;
wherever equality decides a result, callers compare two independent hashes (128 bits) or
the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10  # of text; numpy holds about a hundred times as much

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers of the two hashes
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def separators(pattern_bytes: bytes) -> np.ndarray:
    """Boolean table of the 256 byte values: True for a separator."""
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern_bytes, np.uint8)] = True
    return table


SPACES = separators(b" \t\n\x0b\x0c\r")
NON_WORD = separators(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64), salted."""
    x = x + _U((salt * 0xA0761D6478BD642F + 0x9E3779B97F4A7C15) & _MASK)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = tuple(mix(np.arange(256, dtype=np.uint64), 1000 + s) for s in range(2))


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept and grown as needed)."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        base, out = _BASES[seed], []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[seed] = (out[0], out[1])
    return have


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of values[start:end] for every span, from one running sum."""
    up, down = powers(len(values) + 1, seed)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:], dtype=np.uint64)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64), seed)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(size, dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = at[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(at, before + limit, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


@dataclass
class Words:
    """Words of a slice: byte spans, and the index of each row's first word (n rows + 1)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hash(_BYTES[seed][self.data], self.start, self.end, seed)


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACES) -> Words:
    """Maximal runs of non-separator bytes; a word never crosses a row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, offsets, z, z, np.zeros(len(offsets), np.int64))
    inside = ~sep[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    begins = offsets[:-1]
    before[begins[begins < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offsets[1:] - 1
    after[ends[ends >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def windows(w: Words, hashes: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``size`` words that stays in one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = w.row
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, span_hash(hashes, at, at + size, seed)


def spans(w: Words, gone: np.ndarray) -> pa.ListArray:
    """Ranges of marked words by row as list<struct<first, last>>, counted within the row."""
    before, after = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
    before[1:], after[:-1] = gone[:-1], gone[1:]
    bounds = w.first[:-1][w.counts > 0]
    before[bounds] = False
    after[bounds[1:] - 1] = False
    first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    row = w.row[first]
    pairs = pa.StructArray.from_arrays([pa.array(first - w.first[row], pa.int64()), pa.array(last - w.first[row], pa.int64())], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(w.rows + 1)), pa.int32()), pairs)

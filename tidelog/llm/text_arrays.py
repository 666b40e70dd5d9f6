"""Vectorised text primitives for Arrow batches.

Texts stay UTF-8 bytes in one flat array; words, lines and hashes are computed
for all rows of a slice at once.  White space is exactly ``[\\x20\\x09-\\x0D]``,
so byte positions of word borders never fall inside a character.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that start a character (everything but UTF-8 continuation bytes).
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
#: A random odd base and byte codes for polynomial hashes modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
SLICE_BYTES = 1 << 20

_powers = np.ones(1, U64), np.ones(1, U64)


def give_back() -> None:
    """Returns what a task has freed to the machine: Spark keeps its Python
    workers, and allocators would hold on to the memory beside the next stage."""
    global _powers
    _powers = np.ones(1, U64), np.ones(1, U64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_batch(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives memory back after its last batch."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def by_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function for ``applyInArrow`` that gives memory back after each group."""

    def whole(table):
        try:
            return run(table)
        finally:
            give_back()

    return whole


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(1, n - 1).bit_length()
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            out = np.full(size, base, U64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes behave well."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


class Texts:
    """Rows ``first`` to ``last`` of an Arrow string column as flat bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.first = data, first
        self.offsets = offsets.astype(np.int64)
        self.rows = len(offsets) - 1

    def __len__(self) -> int:
        return self.rows

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where ``member`` holds; no run
        crosses two rows."""
        if not len(member):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins, ends = member.copy(), member.copy()
        begins[1:] &= ~member[:-1]
        ends[:-1] &= ~member[1:]
        filled = self.offsets[1:] > self.offsets[:-1]
        a, b = self.offsets[:-1][filled], self.offsets[1:][filled] - 1
        begins[a], ends[b] = member[a], member[b]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines that are not empty."""
        return self.runs(self.data != 0x0A)

    def of_rows(self, starts: np.ndarray) -> np.ndarray:
        """Borders, in a sorted list of positions, between the rows."""
        return np.searchsorted(starts, self.offsets)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hasher(self, data: np.ndarray | None = None):
        """A function from (starts, ends) to 64-bit hashes of those byte runs."""
        data = self.data if data is None else data
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_CODE[data] * up[:-1], out=total[1:])

        def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))

        return hashes

    def lowered(self) -> np.ndarray:
        return _LOWER[self.data]


def char_starts(data: np.ndarray) -> np.ndarray:
    return _STARTS_CHAR[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's rows in order, about ``limit`` bytes at a time; a longer
    text comes whole and alone.  Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def shingles(texts: Texts, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles,
    A-Z lower-cased; with fewer words, of the whole sequence; without words, none."""
    lower = texts.lowered()
    starts, ends = texts.words()
    word = texts.hasher(lower)(starts, ends)
    borders = texts.of_rows(starts)
    odd = [U64((0xD6E8FEB86659FD93 * (2 * k + 1) ** 3) % 2**64 | 1) for k in range(width)]
    odd_array = np.array(odd, U64)
    n = max(0, len(word) - width + 1)
    total = np.zeros(n, U64)
    for k in range(width):
        total += word[k : k + n] * odd[k]
    total = mix(total)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            out.append(mix((word[a:b] * odd_array[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out

"""Vectorised work on batches of UTF-8 texts: splitting into words and hashing any substring.

A batch is laid out in one byte array with a blank after each text, so no word crosses texts. Hashes of
substrings come from prefix sums of a polynomial over the integers modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes at a time; a longer text makes a pass of its own.
PASS_BYTES = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(20231).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, PASS_BYTES + PASS_BYTES // 8)
        for k, b in enumerate((BASE, BASE_INV)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place on a copy)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


class Texts:
    """Some texts as one padded byte array: text i is data[starts[i]:ends[i]], and data[ends[i]] is a blank."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: slice):
        self.data, self.starts, self.ends, self.rows = data, starts, ends, rows

    def __len__(self) -> int:
        return len(self.starts)

    def lowered(self) -> np.ndarray:
        upper = (self.data >= 65) & (self.data <= 90)
        return self.data + (upper * np.uint8(32))

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends of the runs of bytes other than blank and 9 to 13, and how many each text has."""
        data = self.data if data is None else data
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True))
        first, last = edge[::2], edge[1::2]
        return first, last, np.diff(np.searchsorted(first, np.append(self.starts, len(data))))

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        data = self.data if data is None else data
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters()[data] * powers(len(data))[0], out=out[1:])
        return out


def substring_hash(prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix((prefix[last] - prefix[first]) * powers(len(prefix))[1][first])


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def passes(column: pa.Array, pass_bytes: int = PASS_BYTES) -> Iterator[Texts]:
    """Whole texts in consecutive passes of about pass_bytes."""
    if not len(column):
        return
    data, offsets = raw_texts(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + pass_bytes, "right")) - 1)
        part, lens = data[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1])
        n = to - at
        out = np.full(len(part) + n, 32, np.uint8)
        starts = offsets[at:to] - offsets[at] + np.arange(n)
        out[np.arange(len(part)) + np.repeat(np.arange(n), lens)] = part
        yield Texts(out, starts, starts + lens, slice(at, to))
        at = to


def firsts(counts: np.ndarray) -> np.ndarray:
    """Where each group begins when groups of these sizes follow each other."""
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of these sizes; empty groups give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    last = np.cumsum(counts)
    return total[last] - total[last - counts]

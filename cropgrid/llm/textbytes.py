"""Vectorised work on the UTF-8 bytes of many texts at once: words, lines, rolling hashes, fingerprints.

Everything here takes slices of Arrow batches inside a task. A slice holds a bounded number of bytes
(or one text, if that text alone is longer), so the memory of a task does not depend on its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple]:
    """(rows of the batch, their bytes, offsets into these) with `most` bytes at most, or one long text. Null is empty."""
    for batch in batches:
        column = batch.column(text)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        whole = column.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits, so that any part of the result may serve as a hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse to the powers 0..n-1 (modulo 2^64). Kept for slices, made anew for longer texts."""
    if not _powers or n > len(_powers[0]):
        made = [np.full(max(n, SLICE_BYTES + 1), base, np.uint64) for base in (BASE, INVERSE)]
        for run in made:
            run[0] = 1
            np.multiply.accumulate(run, out=run)
        if n > SLICE_BYTES + 1:
            return made
        _powers[:] = made
    return [run[:n] for run in _powers]


class Rolling:
    """Hashes of any ranges of a byte (or 64-bit) sequence after one pass over it."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def each(self, width: int) -> np.ndarray:
        """Hashes of all ranges of `width`, without index arrays."""
        found = self.sums[width:] - self.sums[:-width]
        found *= self.down[:len(found)]
        found += np.uint64(width)
        return mix(found)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of True that stay within one text."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ as starts, ends and text numbers."""
    return runs(~SPACE[data], offsets)


def grams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the index of each one's first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:count] == text[n - 1:])
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = total * BASE + hashes[at + j]
    return mix(total), at


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags (0/1) each text has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    more[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return more, later


def covered(at: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of `size` places lie in [a, a + width) for some a."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return np.cumsum(steps[:-1]) > 0

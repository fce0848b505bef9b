"""Vectorised words and word fingerprints of whole Arrow string columns.

A word is a run of bytes other than space and \\x09-\\x0D.  Its fingerprint is a 64-bit polynomial over its UTF-8 bytes,
mixed afterwards; it depends on nothing but those bytes, so that all tasks, runs and machines agree on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; one longer text is handled alone.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up = _powers(_BASE, 1 << 16)
    down = _powers(_BASE_INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_Tables.up):
        size = max(n, SLICE + (SLICE >> 2))
        _Tables.up, _Tables.down = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _Tables.up, _Tables.down


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of consecutive rows, about SLICE bytes each; null is empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        i = j


class Words:
    """The words of a slice: row_of (row of each word), first (index of each row's first word), hash, start and length in bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, is_word: np.ndarray = IS_WORD):
        if lower:
            data = LOWER[data]
        self.data, rows = data, len(offsets) - 1
        inside = is_word[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False  # a row never continues the row before
        starts = inside & ~before[:-1]
        at = np.flatnonzero(starts)
        self.start = at
        kept = np.flatnonzero(inside)
        first = np.searchsorted(kept, at)  # where each word begins among the kept bytes
        self.length = np.diff(np.append(first, len(kept)))
        if len(at):
            up, down = _tables(len(kept))
            sums = np.add.reduceat((data[kept].astype(U) + U(1)) * up[: len(kept)], first)
            self.hash = mix(sums * down[first])
        else:
            self.hash = np.zeros(0, U)
        self.row_of = np.searchsorted(offsets, at, "right") - 1
        self.first = np.searchsorted(at, offsets)  # rows + 1 entries
        self.count = np.diff(self.first)
        assert len(self.first) == rows + 1

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s : s + n] for s, n in zip(self.start.tolist(), self.length.tolist(), strict=True)]


def window_hashes(hashes: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Fingerprint of every k consecutive word fingerprints (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, power = np.zeros(n, U), 1
    for i in range(k):
        out += hashes[i : i + n] * U(power)
        power = power * (seed | 1) % (1 << 64)
    return mix(out)

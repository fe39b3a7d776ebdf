"""Texts of an Arrow batch as one byte buffer, and vectorised hashes of its spans.

Hashes are 64-bit polynomial hashes over random byte values. They group and
order; where a contract is exact, equal content is either compared itself or
two independent hashes are used together.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20                 # bytes of text worked on at once
_BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


def byte_class(inside: bytes | list[int] | set[int]) -> np.ndarray:
    """A 256-entry table, true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


WHITE = byte_class([0x20, *range(0x09, 0x0E)])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


_powers = {"n": 0, "up": None, "down": None}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 2 * _powers["n"], 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


class Hashes:
    """Hash of any span ``[start, end)`` of a sequence of bytes or 64-bit values."""

    def __init__(self, values: np.ndarray):
        if values.dtype == np.uint8:
            values = _byte_values()[values]
        up, self.down = _power_tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of length ``k``, by start."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def blocks(batches, column: str = "text", limit: int = BLOCK):
    """Slices of the batches with at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets(batch.column(column)))
        at = 0
        while at < len(sizes):
            ends = np.cumsum(sizes[at:])
            take = max(1, int(np.searchsorted(ends, limit, "right")))
            yield batch.slice(at, take)
            at += take


def offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset:column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and where each text starts (one more at the end)."""
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def words(buf: np.ndarray, bounds: np.ndarray, space: np.ndarray = WHITE):
    """Start, end and text number of each word; no word crosses two texts."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = ~space[buf]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    for cut in (bounds[:-1][np.diff(bounds) > 0],):
        first[cut] |= inside[cut]
        before = cut[cut > 0] - 1
        last[before] |= inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def hex_sha256(data: bytes) -> str:
    import hashlib
    return hashlib.sha256(data).hexdigest()

"""Windows of fixed length grouped by local minima, for exact repeat search.

Every window of ``length`` symbols names one anchor: the smallest of the hashes
of its ``gram``-symbol pieces. Equal windows name the same anchor at the same
place, so repeats can be looked for anchor by anchor. Consecutive windows with
one anchor form a segment, about ``(length - gram) / 2`` windows each. Far fewer
rows than windows are shuffled, and nothing is lost.
"""
from __future__ import annotations

import numpy as np

from voxelspark.llm.text import U64, Hashes, mix

_PLACE = 24                     # low bits that hold the place in a block


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each ``w`` neighbours, by doubling."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (w - span)], x[w - span:]) if w > span else x


def segments(hashes: Hashes, bounds: np.ndarray, length: int, gram: int):
    """Segments of all texts in a block: text number, first window (in the text),
    number of windows, anchor (relative to the first window), key and content hash.

    ``bounds``: where each text starts in the symbols, one more at the end."""
    n = len(hashes.sums) - 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    if n >= 1 << _PLACE:        # one very long text: pieces that overlap by a window less one
        return _pieces(hashes, bounds, length, gram)
    grams = hashes.grams(gram)
    places = np.arange(len(grams), dtype=U64)
    low = sliding_min((grams >> U64(_PLACE) << U64(_PLACE)) | places, length - gram + 1)
    anchor = (low & U64((1 << _PLACE) - 1)).astype(np.int64)
    sizes = np.diff(bounds)
    valid = np.zeros(n + 1, np.int8)
    fits = sizes >= length
    np.add.at(valid, bounds[:-1][fits], 1)
    np.add.at(valid, bounds[1:][fits] - length + 1, -1)
    valid = np.cumsum(valid[:len(anchor)], dtype=np.int8).astype(bool)
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[bounds[:-1][fits]] = True
    new &= valid
    first = np.flatnonzero(new)
    text = np.searchsorted(bounds, first, "right") - 1
    last_window = bounds[text + 1] - length + 1
    count = np.minimum(np.append(first[1:], n), last_window) - first
    at = anchor[first]
    rel = at - first
    content = mix(hashes(first, first + count - 1 + length) ^ (rel.astype(U64) * U64(0xA24BAED4963EE407)))
    return text, first - bounds[text], count, rel, grams[at], content


def _pieces(hashes, bounds, length, gram):
    out = []
    for t in range(len(bounds) - 1):
        lo, hi = int(bounds[t]), int(bounds[t + 1])
        step = (1 << _PLACE) - length
        for at in range(lo, max(lo + 1, hi - length + 1), step):
            to = min(hi, at + step + length - 1)
            part = Hashes.__new__(Hashes)
            part.sums = hashes.sums[at:to + 1]
            part.down = hashes.down[at:to + 1]
            _, first, count, rel, key, content = segments(part, np.array([0, to - at]), length, gram)
            out.append((np.full(len(first), t), first + (at - lo), count, rel, key, content))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def cover(first: np.ndarray, count: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols are covered by the windows that start in the given runs; none of a text shorter than a window."""
    edge = np.zeros(n + 1, np.int64)
    ok = first <= n - length
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, np.minimum(first[ok] + count[ok] - 1 + length, n), -1)
    return np.cumsum(edge[:-1]) > 0

"""Operator 10: substring dedup with longest-previous-factor arrays.

Every byte string of ``length`` bytes that also starts earlier (smaller id, or
same document and earlier place) is a repeat; bytes covered by a repeat are
removed and the first copy stays. Windows are dealt by anchor (``repeats``). In
each group of windows that can be equal, the windows are put in suffix order;
previous and next smaller places in that order give each window its longest
previous factor, and factors of full length are repeats.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, repeats, text, windows

LENGTH, GRAM = 100, 32
RESULT = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def suffix_order(buf: np.ndarray, start: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``buf[start:start+length]`` (equal ones by ``place``), and the
    length of the common prefix of each with the one before it (0 for the first)."""
    chunks = -(-length // 8)
    idx = start[:, None] + np.arange(chunks * 8)
    inside = np.arange(chunks * 8) < length
    raw = np.where(inside, np.r_[buf, np.zeros(8, np.uint8)][np.minimum(idx, len(buf) + 7)], 0).astype(np.uint8)
    keys = np.ascontiguousarray(raw).view(">u8").astype(np.uint64)
    order = np.lexsort((place, *keys.T[::-1]))
    rows = raw[order][:, :length]
    same = rows[1:] == rows[:-1]
    lcp = np.where(same.all(1), length, same.argmin(1))
    return order, np.r_[0, lcp].astype(np.int64)


def previous_factors(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of each string in suffix order, and where it was met (-1: nowhere).

    ``place``: text position of each string in suffix order, ``lcp``: common prefix with the
    string before. A stack finds the nearest string with a smaller place on either side; the
    longer of the two common prefixes is the factor, the one before in order on ties."""
    n = len(place)
    pos, pre = place.tolist(), lcp.tolist()
    best, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []                    # index, common prefix with the entry below
    for i in range(n):
        common = pre[i]
        while stack and pos[stack[-1][0]] > pos[i]:      # i is the next smaller of what is popped
            j, below = stack.pop()
            if common > best[j]:
                best[j], source[j] = common, i
            common = min(common, below)
        if stack:                                        # the previous smaller of i
            best[i], source[i] = common, stack[-1][0]
        stack.append((i, common))
    return np.array(best, np.int64), np.array(source, np.int64)


def _settle(length: int):
    def settle(parts):
        buf, size = parts["symbols"]
        at = np.cumsum(size) - size
        count = parts["count"].astype(np.int64)
        seg = np.repeat(np.arange(len(count)), count)
        off = text.spread(count)
        start = at[seg] + off
        doc, first = parts["doc"][seg], parts["first"][seg] + off
        # only windows met more than once can have a factor of full length
        h = text.Hashes(buf)(start, start + length)
        order = np.argsort(h, kind="stable")
        eq = h[order][1:] == h[order][:-1]
        some = order[np.r_[False, eq] | np.r_[eq, False]] if len(h) else order
        if not len(some):
            return doc[:0], doc[:0], first[:0], first[:0]
        every = some[np.lexsort((first[some], doc[some], h[some]))]
        again = (h[every][1:] == h[every][:-1]) & (doc[every][1:] == doc[every][:-1]) & (first[every][1:] == first[every][:-1])
        head = np.r_[True, ~again]                       # the same place in rows that share an id is one
        some, one = every[head], np.cumsum(head) - 1
        place = np.empty(len(some), np.int64)
        place[np.lexsort((first[some], doc[some]))] = np.arange(len(some))
        dup = np.zeros(len(some), bool)
        for part in _hash_parts(h[some]):
            ranked, lcp = suffix_order(buf, start[some[part]], place[part], length)
            factor, _ = previous_factors(place[part][ranked], lcp)
            dup[part[ranked]] = factor >= length
        hit = every[dup[one]]
        return doc[hit], parts["row"][seg[hit]], first[hit].astype(np.int64), np.ones(len(hit), np.int64)
    return settle


def _hash_parts(h: np.ndarray, limit: int = 1 << 18):
    """Index sets of bounded size; strings that can be equal are in one set unless it would be larger than the limit."""
    if len(h) <= limit:
        yield np.arange(len(h))
        return
    order = np.argsort(h, kind="stable")
    at = 0
    while at < len(order):
        to = min(len(order), at + limit)
        while to < len(order) and h[order[to]] == h[order[to - 1]]:
            to += 1
        yield order[at:to]
        at = to


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte runs and the bytes that remain.

    Null texts are empty. A null id is an id smaller than all others. Rows that share an id
    count as one document: equal strings at the same place of two of them do not repeat each
    other, and each row loses only what its own text repeats. Texts of any length are cut
    whole. Other columns are ignored; an empty table gives no rows."""
    def finish(table, runs):
        ids, sizes, spans, kept = [], [], [], []
        for block in text.blocks(table.combine_chunks().to_batches()):
            buf, bounds = text.utf8(block.column("text"))
            for i, (doc, row) in enumerate(zip(block.column("doc_id").to_pylist(), block.column("row").to_pylist(), strict=True)):
                own = buf[bounds[i]:bounds[i + 1]]
                gone = windows.cover(*runs(doc, row), length, len(own))
                edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                ids.append(doc)
                sizes.append(len(own))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(own[~gone].tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS),
                         pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    found = repeats.remove_repeats(docs, lambda buf, bounds: (buf, bounds), _settle(length), finish, RESULT,
                                   length, gram, same_document=True)
    return found.withColumn("doc_id", exchange.restore_id())


def op10_suffix_dedup(spark, sf_dir):
    found = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))

"""What the two exact repeat removers share: segments, owners, and the way back to the texts.

1. Documents are cut into segments of windows that name the same anchor
   (``windows.segments``) and dealt by anchor. Repeats inside a block of documents
   are settled before the shuffle, so an anchor of a hot passage sends one record
   per block, not one per document.
2. Of equal segments the first document's is the owner; the others are covered.
3. Owners that share an anchor with a different owner fetch their symbols and are
   matched by the operator's own method (``settle``).
4. What is covered goes back to its document by id slot.

A row is known by its id and a hash of its text, so rows that share an id each get what is
covered in their own text; they do count as one document where the rule asks for an earlier one.

Texts are shuffled once, by id slot; steps 3 and 4 read the same exchange.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text, windows
from voxelspark.llm.text import U64

COVERED, OPEN = 1, 2
SEGMENTS = exchange.Records(key="u8", content="u8", doc="i8", row="i8", first="i4", count="i4", kind="u1")
FOUND = exchange.Records(key="u8", doc="i8", row="i8", first="i4", count="i4", kind="u1")
PARTS = exchange.Records(ragged="symbols", key="u8", doc="i8", row="i8", first="i4", count="i4")


def owners(content: np.ndarray, doc: np.ndarray, first: np.ndarray, same_document: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which segments own their content and which are covered by an earlier one.

    With ``same_document`` the earliest segment owns; without, all segments of the
    smallest document do, as repeats inside a document do not count then."""
    order = np.lexsort((first, doc, content))
    c, d, f = content[order], doc[order], first[order]
    head = np.ones(len(c), bool)
    head[1:] = c[1:] != c[:-1]
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    head = d == d[at]
    if same_document:
        head &= f == f[at]      # itself only, or the same place in another row with its id
    own = np.zeros(len(c), bool)
    own[order] = head
    return own, ~own


def _runs(doc, row, first, count):
    """Windows that start in the given segments as few runs (document, row, first, count)."""
    order = np.lexsort((first, row, doc))
    doc, row, first, end = doc[order], row[order], first[order], (first + count)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (first[1:] > end[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return doc, row, first, count
    return doc[at], row[at], first[at], np.maximum.reduceat(end, at) - first[at]


def _by_key(parts: dict, limit: int = 1 << 21):
    """The parts of a slot, those of a key together, in pieces of about ``limit`` windows (one key at least)."""
    raw, size = parts["symbols"]
    at, order = np.cumsum(size) - size, np.argsort(parts["key"], kind="stable")
    key, count = parts["key"][order], parts["count"][order].astype(np.int64)
    new = np.r_[True, key[1:] != key[:-1]][:len(key)]
    before = np.maximum.accumulate(np.where(new, np.cumsum(count) - count, 0))
    for rows in np.split(order, np.flatnonzero(np.diff(before // limit)) + 1):
        own = {k: v[rows] for k, v in parts.items() if k != "symbols"}
        own["symbols"] = raw[np.repeat(at[rows], size[rows]) + text.spread(size[rows])], size[rows]
        yield own


def remove_repeats(docs: DataFrame, symbols: Callable, settle: Callable, finish: Callable, result: str,
                   length: int, gram: int, same_document: bool) -> DataFrame:
    """``symbols(buf, bounds)``: values to hash and where each text starts in them.
    ``settle(parts)``: runs of covered windows among open segments (document, row, first, count).
    ``finish(table, covered)``: the result for rows and their runs, looked up by id and ``row``."""
    n = exchange.slots_for(docs)
    docs = exchange.documents(docs, n_slots=n).withColumn("row", F.xxhash64("text"))

    def cut(batches):
        for block in text.blocks(batches):
            ids = block.column("doc_id").to_numpy()
            values, bounds = symbols(*text.utf8(block.column("text")))
            of, first, count, _, key, content = windows.segments(text.Hashes(values), bounds, length, gram)
            doc, row = ids[of], block.column("row").to_numpy()[of]
            own, covered = owners(content, doc, first, same_document)
            d, r, f, c = _runs(doc[covered], row[covered], first[covered], count[covered])
            k = text.mix(d.view(U64).copy())
            cols = {"key": np.r_[key[own], k], "content": np.r_[content[own], k], "doc": np.r_[doc[own], d], "row": np.r_[row[own], r],
                    "first": np.r_[first[own], f], "count": np.r_[count[own], c],
                    "kind": np.r_[np.full(own.sum(), OPEN), np.full(len(d), COVERED)]}
            if len(cols["key"]):
                yield SEGMENTS.pack((cols["key"] % U64(n)).astype(np.int64), cols)

    def meet(table: pa.Table) -> pa.Table:
        s = SEGMENTS.unpack(table)
        done = s["kind"] == COVERED
        a = {k: v[~done] for k, v in s.items()}
        own, covered = owners(a["content"], a["doc"], a["first"], same_document)
        # open: owners whose anchor another content names too
        key = a["key"][own]
        order = np.lexsort((a["content"][own], key))
        k, c = key[order], a["content"][own][order]
        group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1 if len(k) else np.zeros(0, np.int64)
        kinds = np.bincount(group, np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else None)
        still = np.zeros(len(k), bool)
        still[order] = kinds[group] > 1
        open_ = np.flatnonzero(own)[still]
        d, r, f, c = _runs(np.r_[a["doc"][covered], s["doc"][done]], np.r_[a["row"][covered], s["row"][done]], np.r_[a["first"][covered], s["first"][done]],
                        np.r_[a["count"][covered], s["count"][done]])
        zero = np.zeros(len(d), np.uint64)
        cols = {"key": np.r_[a["key"][open_], zero], "doc": np.r_[a["doc"][open_], d], "row": np.r_[a["row"][open_], r],
                "first": np.r_[a["first"][open_], f], "count": np.r_[a["count"][open_], c],
                "kind": np.r_[np.full(len(open_), OPEN), np.full(len(d), COVERED)]}
        return pa.Table.from_batches([FOUND.pack(exchange.id_slot(cols["doc"], n), cols)])

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        found = FOUND.unpack(right)
        want = np.flatnonzero(found["kind"] == OPEN)
        if not left.num_rows or not len(want):
            return pa.Table.from_batches([PARTS.empty()])
        want = want[np.argsort(found["doc"][want], kind="stable")]
        out = []
        for block in text.blocks(left.combine_chunks().to_batches()):
            ids, rows = block.column("doc_id").to_numpy(), block.column("row").to_numpy()
            values, bounds = symbols(*text.utf8(block.column("text")))
            lo = np.searchsorted(found["doc"][want], ids, "left")
            hi = np.searchsorted(found["doc"][want], ids, "right")
            row = np.repeat(np.arange(len(ids)), hi - lo)
            rec = want[np.repeat(lo, hi - lo) + text.spread(hi - lo)]
            own = found["row"][rec] == rows[row]
            row, rec = row[own], rec[own]
            start = bounds[row] + found["first"][rec]
            size = found["count"][rec] - 1 + length
            raw = values[np.repeat(start, size) + text.spread(size)].tobytes()
            cols = {"key": found["key"][rec], "doc": ids[row], "row": rows[row], "first": found["first"][rec], "count": found["count"][rec],
                    "symbols": (np.frombuffer(raw, np.uint8), size * values.itemsize)}
            out.append(PARTS.pack((cols["key"] % U64(n)).astype(np.int64), cols))
        return pa.Table.from_batches(out)

    def match(table: pa.Table) -> pa.Table:
        found = [settle(p) for p in _by_key(PARTS.unpack(table))]
        d, r, f, c = _runs(*(np.concatenate(x) for x in zip(*found, strict=True)))
        cols = {"key": np.zeros(len(d), np.uint64), "doc": d, "row": r, "first": f, "count": c, "kind": np.full(len(d), COVERED)}
        return pa.Table.from_batches([FOUND.pack(exchange.id_slot(d, n), cols)])

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        found = FOUND.unpack(right)
        take = found["kind"] == COVERED
        order = np.lexsort((found["row"][take], found["doc"][take]))
        doc, row, first, count = (found[k][take][order] for k in ("doc", "row", "first", "count"))

        def runs(doc_id: int, row_hash: int):
            a, b = np.searchsorted(doc, doc_id, "left"), np.searchsorted(doc, doc_id, "right")
            a, b = a + np.searchsorted(row[a:b], row_hash, "left"), a + np.searchsorted(row[a:b], row_hash, "right")
            return first[a:b].astype(np.int64), count[a:b].astype(np.int64)
        return finish(left, runs)

    found = docs.mapInArrow(cut, exchange.PACKED).groupBy("slot").applyInArrow(meet, exchange.PACKED)
    parts = docs.groupBy("slot").cogroup(found.groupBy("slot")).applyInArrow(fetch, exchange.PACKED)
    rest = parts.groupBy("slot").applyInArrow(match, exchange.PACKED)
    return docs.groupBy("slot").cogroup(found.unionByName(rest).groupBy("slot")).applyInArrow(close, result)

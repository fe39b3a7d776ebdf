"""Operator 9: substring dedup by relative Lempel-Ziv parsing.

Documents are parsed against reference blocks: the first copies of all segments,
dealt by anchor, so each block holds whatever can match the segments that come to
it. A segment that equals a reference segment is one factor. The others are
factored greedily against the block's index: from a word, the longest match in an
earlier document is a factor; factors of ``length`` words or more are duplicate
spans, and parsing goes on ``length - 1`` words before a factor's end, so windows
across a factor boundary are looked up too.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, repeats, text, windows

LENGTH, GRAM = 13, 5
RESULT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def parse(words: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int):
    """Factors of ``length`` words or more: (segment, first word, words).

    ``words``: word hashes of all segments of a reference block, segment i at
    ``start[i]`` with ``size[i]`` words of document ``doc[i]``."""
    count = size - length + 1
    seg = np.repeat(np.arange(len(size)), count)
    at = start[seg] + text.spread(count)
    h = text.Hashes(words)(at, at + length)
    order = np.lexsort((doc[seg], h))                    # the index: windows by hash, earliest document first
    hs, ds = h[order], doc[seg][order]
    head = np.r_[True, hs[1:] != hs[:-1]] if len(hs) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    earliest = order[np.flatnonzero(head)]               # reference window of each hash
    ref = np.empty(len(h), np.int64)
    ref[order] = earliest[group]
    met = doc[seg[ref]] < doc[seg]
    of_segment = np.append(0, np.cumsum(count))
    out = []
    for s in np.unique(seg[met]).tolist():
        base, n = int(of_segment[s]), int(count[s])
        hit = met[base:base + n].tolist()
        i = 0
        while i < n:
            if not hit[i]:
                i += 1
                continue
            r = int(ref[base + i])
            q = int(at[r])
            room = min(int(size[s]) - i, int(start[seg[r]] + size[seg[r]]) - q)
            mine = words[start[s] + i:start[s] + i + room]
            differ = np.flatnonzero(mine != words[q:q + room])
            long = int(differ[0]) if len(differ) else room
            if long < length:                            # not equal after all: only the hashes met
                i += 1
                continue
            out.append((s, i, long))
            i += long - length + 1                       # the boundary: windows past this factor's last one
    return out


def _settle(length: int):
    def settle(parts):
        raw, size = parts["symbols"]
        words = np.frombuffer(raw.tobytes(), np.uint64)
        size = size // 8
        found = np.array(parse(words, np.cumsum(size) - size, size, parts["doc"], length), np.int64).reshape(-1, 3)
        s = found[:, 0]
        return parts["doc"][s], parts["row"][s], parts["first"][s] + found[:, 1], found[:, 2] - length + 1
    return settle


def word_hashes(buf: np.ndarray, bounds: np.ndarray):
    start, end, _ = text.words(buf, bounds)
    return text.Hashes(buf)(start, end), np.searchsorted(start, bounds)


def remove_repeated_words(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, spans, kept``: removed runs of words and the words that remain, joined by a space.

    A word goes if a window of ``length`` words over it also starts in a document with a
    smaller id. Null texts have no words. A null id is an id smaller than all others. Rows that
    share an id do not remove words from each other, and each loses only what its own text repeats.
    Texts of any length are cut whole. Other columns are ignored; an empty table gives no rows."""
    def finish(table, runs):
        ids, sizes, spans, kept = [], [], [], []
        for block in text.blocks(table.combine_chunks().to_batches()):
            buf, bounds = text.utf8(block.column("text"))
            whole = buf.tobytes()
            for i, (doc, row) in enumerate(zip(block.column("doc_id").to_pylist(), block.column("row").to_pylist(), strict=True)):
                own = whole[bounds[i]:bounds[i + 1]].split()
                gone = windows.cover(*runs(doc, row), length, len(own))
                edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0])).reshape(-1, 2).tolist()
                ids.append(doc)
                sizes.append(len(own))
                spans.append([{"start": a, "end": b} for a, b in edge])
                for a, b in reversed(edge):
                    del own[a:b]
                kept.append(b" ".join(own))
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS),
                         pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "kept"])

    found = repeats.remove_repeats(docs, word_hashes, _settle(length), finish, RESULT, length, gram, same_document=False)
    return found.withColumn("doc_id", exchange.restore_id())


def op9_lz_dedup(spark, sf_dir):
    found = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

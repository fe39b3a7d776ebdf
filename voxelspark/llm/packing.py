"""Operator 6: packing documents into sequences by patterns from a non-negative least squares fit.

The plan needs only how many pieces there are of each length, at most ``length``
numbers whatever the input: patterns of two, then of three lengths that fill a sequence,
repeat counts fitted to the histogram, rounded, and the residual packed best-fit from
the longest piece down, all on counts. Pieces then take their places by rank among
the pieces of their length; ranks come from counts per task, not from a global sort.
"""
from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text
from voxelspark.llm.tokens import encoder

LENGTH = 2048
END = 0
PATTERNS = 40_000               # patterns of three pieces fitted, about
STEPS = 200                     # steps of the fit
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


def cut_pieces(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``length`` tokens, and the rank of each among its task's pieces of that length."""
    def run(batches):
        enc, stop = encoder(path, "<u4"), np.array([end], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for block in text.blocks(batches):
            rows = []
            for doc, ids in zip(block.column("doc_id").to_pylist(), enc(block.column("text")), strict=True):
                ids += stop
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at:at + 4 * length]
                    n = len(own) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
    return exchange.documents(docs, id_col, text_col).mapInArrow(run, PIECES)


def patterns(counts: np.ndarray, length: int, pieces: int, most: int = PATTERNS) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``length``, from lengths that occur. All pairs; of
    three, for each longest piece those whose rarest length is most frequent, so that every length has some."""
    have = np.flatnonzero(counts[:length] > 0)
    have = have[have > 0]
    if pieces == 2:
        rest = length - have
        ok = (have >= rest) & (counts[rest] > 0)
        return np.stack([have[ok], rest[ok], np.zeros(ok.sum(), np.int64)], 1)
    a, b = np.meshgrid(have, have, indexing="ij")
    c = length - a - b
    ok = (a >= b) & (b >= c) & (c > 0) & (counts[np.clip(c, 0, length)] > 0)
    rows = np.stack([a[ok], b[ok], c[ok]], 1)
    order = np.lexsort((rows[:, 1] * 7919 % length, -counts[rows].min(1), rows[:, 0]))
    longest = rows[order, 0]
    nth = np.arange(len(order)) - np.searchsorted(longest, longest)
    return rows[order[nth < -(-most // max(1, len(np.unique(longest))))]]


def usage(rows: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    return sum(np.bincount(rows[:, k], x * (rows[:, k] > 0), size) for k in range(3))


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts ``x`` that bring ``A x`` close to ``counts`` in least squares, weighted by
    length as long pieces are hardest to place. Multiplicative steps stay non-negative and never raise the error."""
    size = len(counts)
    used = (rows > 0).astype(float)
    weight = np.arange(size, dtype=float)

    def back(y):
        return ((weight * y)[rows] * used).sum(1)
    want = back(counts.astype(float))
    x = np.full(len(rows), counts.sum() / max(1, 3 * len(rows)))
    for _ in range(steps):
        x *= want / np.maximum(back(usage(rows, x, size)), 1e-12)
    return x


def best_fit(counts: np.ndarray, length: int) -> list[tuple[list, int]]:
    """Best-fit decreasing on counts: ``([(piece length, copies), ...], sequences)``."""
    room: list[list] = [[] for _ in range(length + 1)]      # open sequences by free places
    for size in range(length, 0, -1):
        n = int(counts[size])
        while n:
            free = next((f for f in range(size, length) if room[f]), None)
            if free is None:
                copies = length // size
                if n >= copies:
                    room[length - copies * size].append(([(size, copies)], n // copies))
                if n % copies:
                    room[length - n % copies * size].append(([(size, n % copies)], 1))
                break
            runs, many = room[free].pop()
            take = min(n, many)
            if many > take:
                room[free].append((runs, many - take))
            room[free - size].append(([*runs, (size, 1)], take))
            n -= take
    return [entry for entries in room for entry in entries]


def plan(counts: np.ndarray, length: int = LENGTH) -> list[tuple[list, int]]:
    """How often each pattern is used, for a histogram ``counts[0..length]`` of piece lengths."""
    left = counts.astype(np.int64).copy()
    out = [([(length, 1)], int(left[length]))] if left[length] else []
    left[length] = 0
    for pieces in (2, 3):
        rows = patterns(left, length, pieces)
        x = fit(rows, left)
        # rounded down so that no length is used up beyond what there is and the residual stays mixed
        share = np.minimum(1, left / np.maximum(usage(rows, x, len(left)), 1e-9))
        x = np.floor(x * np.where(rows > 0, share[rows], 1).min(1) + 1e-6).astype(np.int64) if len(rows) else x
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] <= 0:
                break
            need = Counter(int(v) for v in rows[k] if v)
            many = min(int(x[k]), *(int(left[v]) // c for v, c in need.items()))
            if many > 0:
                out.append((sorted(need.items(), reverse=True), many))
                for v, c in need.items():
                    left[v] -= c * many
    return out + best_fit(left, length)


def places(chosen: list[tuple[list, int]]) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, copies, first sequence, offset), sorted."""
    rank: dict = defaultdict(int)
    rows, sequence = [], 0
    for runs, many in chosen:
        offset = 0
        for size, copies in runs:
            rows.append((size, rank[size], copies, sequence, offset))
            rank[size] += copies * many
            offset += copies * size
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts are empty: their end id alone. Rows are packed one by one, so rows that share
    an id, and null ids, have pieces each. An empty table gives no rows; other columns are ignored."""
    pieces = exchange.cut_lineage(cut_pieces(docs, length, end, path, id_col, text_col))
    made = exchange.cut_lineage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(length + 1, np.int64)
    for size, n in made.groupBy("length").agg(F.sum("n")).collect():      # at most ``length`` rows
        counts[size] = n
    rows = places(plan(counts, length))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)    # one row a task
    base = made.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def place(batches):
        table = held.value
        key = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            size, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy() + b.column("base").to_numpy()
            at = np.searchsorted(key, (size << 44) + rank, "right") - 1
            nth = rank - table[at, 1]
            sequence = table[at, 3] + nth // table[at, 2]
            offset = table[at, 4] + nth % table[at, 2] * size
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep[:3]), pa.array(size), b.column(keep[4]), pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.join(base, ["part", "length"]).mapInArrow(place, out).withColumn("doc_id", exchange.restore_id())


def op6_pattern_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

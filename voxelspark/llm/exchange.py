"""Columns of many small records as one binary row per block and slot.

Operators that deal hundreds of small records per document shuffle them packed:
a task sorts its records by slot and emits one row per slot, so that the shuffle
moves columns instead of millions of rows. Slots follow the session's number of
shuffle partitions, so a slot's records stay a bounded share of the input.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm.text import U64
from voxelspark.session import cut_lineage, shared_folder

__all__ = ["NO_ID", "PACKED", "Records", "cut_lineage", "documents", "id_slot", "restore_id", "shared_folder", "slots", "slots_for", "unique_ids"]

NO_ID = -(1 << 63)              # stands for a null id: smaller than every other
PACKED = "slot int, n int, data binary"
CODEC = "zstd"                  # of squeezed rows
_ARROW = pa.schema([("slot", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def slots(spark: SparkSession, per_partition: int = 1) -> int:
    """Number of slots: by default one for each shuffle partition, so that a task's records
    for all slots stay few and long rows."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")) + 1


def slots_for(docs: DataFrame, text_col: str = "text", slot_bytes: int = 8 << 20) -> int:
    """Slots of about ``slot_bytes`` of text (summed first), and no fewer than shuffle partitions: what a task
    holds of one slot does not grow with the input."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(slots(docs.sparkSession), total // slot_bytes + 1)


def id_slot(ids, n: int):
    """Slot of a document id: the same in Spark (a column) and numpy (an array)."""
    if isinstance(ids, np.ndarray):
        return (ids ^ (ids.view(U64) >> U64(15)).view(np.int64)) % n
    return F.pmod(ids.bitwiseXOR(F.shiftrightunsigned(ids, 15)), F.lit(n)).cast("int")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int | None = None) -> DataFrame:
    """``doc_id`` and ``text`` without nulls, whatever else the table holds."""
    out = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return out if n_slots is None else out.withColumn("slot", id_slot(F.col("doc_id"), n_slots))


FEW = 200_000                   # rows of ids (some MB) that are broadcast, counted first


def unique_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "key") -> DataFrame:
    """The table with a column ``key``: a number for each row, in the order of ids (null first).

    Usually the id itself. Of rows that share an id one keeps it, that with the smallest hash of its text; the
    others count as documents after all others, ordered by id and hash. Nothing known of one row is then taken for
    another's. Needs ids below 2^62."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    shared = cut_lineage(df.groupBy(own.alias(key)).count().filter("count > 1").select(key))
    n = shared.count()
    df = df.withColumn(key, own)
    if not n:
        return df
    few = F.broadcast(shared) if n <= FEW else shared
    top = df.agg(F.max(key)).first()[0]
    rank, least = f"{key}_rank", f"{key}_least"
    rows = df.join(few, key, "left_semi").withColumn(rank, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = rows.repartitionByRange(key, rank).sortWithinPartitions(key, rank).withColumn(rank, F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    first = rows.groupBy(key).agg(F.min(rank).alias(least))
    rows = rows.join(F.broadcast(first) if n <= FEW else first, key)
    again = F.when(F.col(rank) == F.col(least), F.col(key)).otherwise(F.lit(max(top, 0) + 1) + F.col(rank))
    return df.join(few, key, "left_anti").select(*df.columns).unionByName(rows.withColumn(key, again).select(*df.columns))


def restore_id(column: str = "doc_id"):
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


class Records:
    """Named fixed-width columns, and optionally one column of byte strings (``ragged``).

    ``squeeze``: a row holds its columns byte by byte (all first bytes, all second ones, ...), compressed. Worth
    its time where most high bytes are equal; byte strings follow as they are."""

    def __init__(self, ragged: str | None = None, squeeze: bool = False, **dtypes: str):
        self.squeeze = squeeze
        self.dtypes = {k: np.dtype(v) for k, v in dtypes.items()}
        self.ragged = ragged
        if ragged:
            self.dtypes["_size"] = np.dtype("i4")
        self.width = sum(d.itemsize for d in self.dtypes.values())

    def pack(self, slot: np.ndarray, cols: dict) -> pa.RecordBatch:
        """One row per slot. A ragged column is a pair (all bytes, sizes)."""
        if not len(slot):
            return self.empty()
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        ends = np.append(cut[1:], len(slot))
        cols = dict(cols)
        if self.ragged:
            data, sizes = cols.pop(self.ragged)
            start = (np.cumsum(sizes) - sizes)[order]
            cols["_size"] = sizes[order]
            whole = bool((order[1:] > order[:-1]).all())         # in order already: a row's bytes are one piece
            data, start, end = memoryview(data.tobytes()), start.tolist(), (start + sizes[order]).tolist()
        done = [(cols[k] if k == "_size" else cols[k][order]).astype(d, copy=False) for k, d in self.dtypes.items()]
        rows = []
        if self.squeeze:
            planes = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(slot), -1).T for c in done])
        for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
            if self.squeeze:
                parts = [pa.compress(planes[:, a:b].tobytes(), codec=CODEC, asbytes=True)]
                if self.ragged:
                    parts.insert(0, len(parts[0]).to_bytes(4, "little"))
            else:
                parts = [c[a:b].tobytes() for c in done]
            if self.ragged:
                parts += [data[start[a]:end[b - 1]]] if whole else [data[i:j] for i, j in zip(start[a:b], end[a:b], strict=True)]
            rows.append(b"".join(parts))
        return pa.RecordBatch.from_arrays(
            [pa.array(slot[cut], pa.int32()), pa.array(ends - cut, pa.int32()), pa.array(rows, pa.binary())], schema=_ARROW)

    def unpack(self, rows) -> dict:
        """All columns of packed rows (a table or batch), one after the other."""
        ns, datas = rows.column("n").to_pylist(), rows.column("data").to_pylist()
        if self.squeeze:
            return self._unsqueeze(ns, datas)
        out: dict = {k: [] for k in self.dtypes}
        tail = []
        for n, data in zip(ns, datas, strict=True):
            at = 0
            for k, d in self.dtypes.items():
                out[k].append(np.frombuffer(data, d, n, at))
                at += n * d.itemsize
            tail.append(np.frombuffer(data, np.uint8, len(data) - at, at))
        cols = {k: np.concatenate(v) if v else np.zeros(0, self.dtypes[k]) for k, v in out.items()}
        if self.ragged:
            cols[self.ragged] = (np.concatenate(tail) if tail else np.zeros(0, np.uint8), cols.pop("_size").astype(np.int64))
        return cols

    def _unsqueeze(self, ns: list[int], datas: list[bytes]) -> dict:
        planes, done, tail = np.empty((self.width, sum(ns)), np.uint8), 0, []
        for n, data in zip(ns, datas, strict=True):
            if self.ragged:
                at = 4 + int.from_bytes(data[:4], "little")
                tail.append(np.frombuffer(data, np.uint8, len(data) - at, at))
                data = data[4:at]
            planes[:, done:done + n] = np.frombuffer(pa.decompress(data, n * self.width, codec=CODEC), np.uint8).reshape(self.width, n)
            done += n
        cols, at = {}, 0
        for k, d in self.dtypes.items():
            cols[k] = np.array(planes[at:at + d.itemsize].T, order="C").reshape(-1).view(d)
            at += d.itemsize
        if self.ragged:
            cols[self.ragged] = (np.concatenate(tail) if tail else np.zeros(0, np.uint8), cols.pop("_size").astype(np.int64))
        return cols

    def empty(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _ARROW], schema=_ARROW)

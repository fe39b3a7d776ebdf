"""Operator 2: token ids in Arrow files of equal-length sequences.

Documents are dealt to files by ranges of ids. A file holds one Arrow table
``ids: fixed_size_list<token>[length], mask: fixed_size_list<bool>[length]``:
its documents' tokens in a row, the last sequence filled up. The mask, one bit
each, tells tokens from filling. Beside it lies an index ``doc_id, start, n_tokens``
in the same format. Both are mapped into memory, so any
sequence or document is read without decoding or copying what comes before it.
Files are written under a temporary name and moved, so a repeated task leaves the
same file, and only files named in the manifest count.
"""
from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text
from voxelspark.llm.tokens import encoder

LENGTH = 2048
END = 1
BATCH = 512                     # sequences in one record batch
FILES = "file string, docs long, tokens long, low long"
DOCS = exchange.Records(ragged="ids", doc="i8")


def _store(uri: str):
    """File system and path of a folder or file, local or not."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, ids: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: int) -> None:
    """One token file and its index."""
    total = int(sizes.sum())
    n = -(-total // length)
    flat, mask = np.zeros(n * length, ids.dtype), np.zeros(n * length, bool)
    flat[:total], mask[:total] = ids, True
    table = pa.table({"ids": pa.FixedSizeListArray.from_arrays(pa.array(flat), length),
                      "mask": pa.FixedSizeListArray.from_arrays(pa.array(mask), length)})
    index = pa.table({"doc_id": doc, "start": np.cumsum(sizes) - sizes, "n_tokens": sizes})
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    for part, data, batch in ((path, table, BATCH), (f"{path}.index", index, 1 << 20)):
        attempt = f"{part}.{uuid.uuid4().hex}"
        with store.open_output_stream(attempt) as out, pa.ipc.new_file(out, data.schema) as writer:
            writer.write_table(data, max_chunksize=batch)
        store.move(attempt, part)


class Tokens:
    """Random access to one token file. Nothing is copied from a local file."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        local = isinstance(store, fs.LocalFileSystem)
        self.files = [pa.memory_map(p) if local else store.open_input_file(p) for p in (path, f"{path}.index")]
        self.data, index = (pa.ipc.open_file(f) for f in self.files)
        self.length = self.data.schema.field("ids").type.list_size
        self.index = index.read_all()
        self.rows = [self.data.get_batch(i) for i in range(self.data.num_record_batches)]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.rows = []
        for f in self.files:
            f.close()

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of sequence ``i``, views of the file."""
        batch, row = self.rows[i // BATCH], i % BATCH
        return tuple(batch.column(c).flatten()[row * self.length:(row + 1) * self.length] for c in ("ids", "mask"))

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, of the file's tokens in a row."""
        size, parts = BATCH * self.length, []
        while n > 0:
            flat = self.rows[start // size].column("ids").flatten()
            take = min(n, size - start % size)
            parts.append(flat[start % size:start % size + take].to_numpy())
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, length: int = LENGTH, end: int = END, path: str | None = None,
                 dtype: str = "u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files and return the manifest ``file, docs, tokens, low, start``.

    ``dtype`` must hold the vocabulary's ids. Null texts are empty: their end id alone. A null
    id sorts first; rows that share an id lie beside each other, ordered by their ids. An empty
    table writes no file. Other columns are ignored."""
    docs = exchange.documents(docs, id_col, text_col)
    n = exchange.slots(docs.sparkSession, 2)
    bounds = np.unique(np.array(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) or [], np.float64))

    def encode(batches):
        enc = encoder(path, dtype)
        stop = np.array([end], dtype).tobytes()
        for block in text.blocks(batches):
            ids = block.column("doc_id").to_numpy()
            raw = [t + stop for t in enc(block.column("text"))]
            cols = {"doc": ids, "ids": (np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))}
            yield DOCS.pack(np.searchsorted(bounds, ids, "right"), cols)

    def write(key, table):
        d = DOCS.unpack(table)
        raw, sizes = d["ids"]
        at = np.cumsum(sizes) - sizes
        whole = raw.tobytes()
        order = np.argsort(d["doc"], kind="stable")
        doc = d["doc"][order]
        if (doc[1:] == doc[:-1]).any():                  # rows that share an id: by content
            order = np.array(sorted(order.tolist(), key=lambda i: (int(d["doc"][i]), whole[at[i]:at[i] + sizes[i]])))
        flat = np.frombuffer(b"".join([whole[i:j] for i, j in zip(at[order].tolist(), (at + sizes)[order].tolist(), strict=True)]), dtype)
        counts = sizes[order] // np.dtype(dtype).itemsize
        file = f"{folder}/part-{key[0].as_py():06d}.arrow"
        write_file(file, flat, counts, doc, length)
        return pa.table({"file": [file], "docs": pa.array([len(doc)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()),
                         "low": pa.array([int(doc[0])], pa.int64())})

    files = docs.mapInArrow(encode, exchange.PACKED).groupBy("slot").applyInArrow(write, FILES)
    manifest = exchange.cut_lineage(files)               # written once: the files exist from here on
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)   # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, ``start`` counted over all files."""
    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with Tokens(file) as t:
                    start, n = t.index["start"].to_numpy(), t.index["n_tokens"].to_numpy()
                    crc = [zlib.crc32(t.span(a, b).astype("<u4").tobytes()) for a, b in zip(start.tolist(), n.tolist(), strict=True)]
                    out = pa.RecordBatch.from_pydict({"doc_id": t.index["doc_id"].combine_chunks(), "start": pa.array(start + base, pa.int64()),
                                                      "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                yield out

    spread = manifest.repartition(exchange.slots(manifest.sparkSession, 1), "file")
    return (spread.select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
            .withColumn("doc_id", exchange.restore_id()))


def token_folder(spark: SparkSession) -> str:
    return f"{exchange.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


def op2_token_files(spark, sf_dir):
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), token_folder(spark))
    return read_tokens(manifest)

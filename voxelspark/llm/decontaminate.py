"""Operator 1: benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to lower-case words (digits, letters, everything beyond
ASCII) joined by one space. Every run of ten item words is a pattern; an item of
fewer words is one pattern. The automaton passes once over each normalised text,
and hits are mapped back to words and characters of the original.

The patterns of one automaton are bounded by ``SHARD_CHARS``; a larger benchmark
becomes several automata, which are applied one after the other in the same stage,
so documents are never shuffled.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text

WINDOW = 10
SHARD_CHARS = 4_000_000         # pattern characters in one automaton (about 200 MB in a task)
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BREAK = text.byte_class([c for c in range(256) if SPLIT[c] == 32])
FOUND = ("doc_id long, n_words long, n_hit long, items array<string>, "
         "spans array<struct<start:int,end:int>>, text string")
_PAIRS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def item_windows(raw: bytes, window: int = WINDOW) -> list[bytes]:
    words = raw.translate(SPLIT).split()
    if not words:
        return []
    return [b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))]


def patterns(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``pattern, items``: each distinct pattern and the items it comes from."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("item IS NOT NULL")

    def cut(batches):
        for b in batches:
            rows = [(i, p) for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True)
                    for p in dict.fromkeys(item_windows(t.encode(), window))]
            yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], pa.string()),
                                              "pattern": pa.array([r[1] for r in rows], pa.binary())})
    return (items.mapInArrow(cut, "item string, pattern binary")
            .groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")))


def shards(spark, found: DataFrame, limit: int):
    """The patterns in broadcast lists of at most about ``limit`` characters each."""
    found = exchange.cut_lineage(found)
    # the few patterns and lists an automaton holds are bounded by the number of shards
    chars = found.agg(F.sum(F.length("pattern") + F.aggregate("items", F.lit(0), lambda a, i: a + F.length(i) + 8))).first()[0] or 0
    n = max(1, -(-int(chars) // limit))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("pattern"), F.lit(n)))
    for k in range(n):
        rows = dealt.filter(F.col("shard") == k).select("pattern", "items").collect()
        if rows:
            yield spark.sparkContext.broadcast([(bytes(r[0]).decode("latin-1"), list(r[1])) for r in rows])


_built: dict = {}


def automaton(patterns: list):
    """The automaton of a broadcast list; a worker process keeps the one it built last."""
    if _built.get("of") is not patterns:
        import ahocorasick
        built = ahocorasick.Automaton()
        for p, items in patterns:
            built.add_word(f" {p} ", (p.count(" ") + 1, items))
        built.make_automaton()
        _built.update(of=patterns, built=built)
    return _built["built"]


def hits(machine, raw: bytes):
    """Number of words, the words hit, and the items of the patterns found."""
    words = raw.translate(SPLIT).split()
    found = list(machine.iter(f" {b' '.join(words).decode('latin-1')} ")) if words else []
    if not found:
        return len(words), None, ()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = np.searchsorted(ends, np.array([e for e, _ in found]))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, last + 1 - np.array([v[0] for _, v in found]), 1)
    np.add.at(edge, last + 1, -1)
    return len(words), np.cumsum(edge[:-1]) > 0, {i for _, v in found for i in v[1]}


def _char_runs(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as character offsets of the original text."""
    buf = np.frombuffer(raw, np.uint8)
    start, end, _ = text.words(buf, np.array([0, len(buf)]), BREAK)
    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0])).reshape(-1, 2)
    chars = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    return [(int(chars[start[a]]), int(chars[end[b - 1]])) for a, b in edge.tolist()]


def _merge(a: list, b: list) -> list:
    out: list = []
    for s, e in sorted((*a, *b)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans``: hit words, items met, and hit runs in characters.

    A null text has no words; a null id stays null. Items without an id are left out, items
    without words match nothing, an empty benchmark hits nothing. Rows are judged one by one,
    so repeated rows and ids give a row each; other columns are ignored."""
    docs = exchange.documents(docs, id_col, text_col)
    lists = list(shards(docs.sparkSession, patterns(benchmark, item_col, item_text_col, window), shard_chars))
    state = docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                        F.array().cast("array<string>").alias("items"),
                        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), "text")

    def scan(held, first, last):
        def run(batches):
            machine = automaton(held.value) if held is not None else None
            for batch in text.blocks(batches):
                ids, n, n_hit, items, spans = batch.column("doc_id"), [], [], [], []
                before = batch.column("items").to_pylist() if not first else None
                runs = batch.column("spans").to_pylist() if not first else None
                buf, at = text.utf8(batch.column("text"))
                whole = buf.tobytes()
                for i in range(batch.num_rows):
                    raw = whole[at[i]:at[i + 1]]
                    words, hit, met = hits(machine, raw) if machine is not None else (len(raw.translate(SPLIT).split()), None, ())
                    own = _char_runs(raw, hit) if hit is not None else []
                    count = int(hit.sum()) if hit is not None else 0
                    if not first:
                        old = [(r["start"], r["end"]) for r in runs[i]]
                        met, own = {*met, *before[i]}, _merge(own, old)
                        if old:
                            count = len(b" ".join(raw.decode()[a:b].encode() for a, b in own).translate(SPLIT).split())
                    n.append(words)
                    n_hit.append(count)
                    items.append(sorted(met))
                    spans.append([{"start": a, "end": b} for a, b in own])
                texts = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text").cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                     pa.array(spans, _PAIRS), texts], ["doc_id", "n_words", "n_hit", "items", "spans", "text"])
        return run

    lists = lists or [None]
    for k, held in enumerate(lists):
        state = state.mapInArrow(scan(held, k == 0, k == len(lists) - 1), FOUND)
    return state.drop("text").withColumn("doc_id", exchange.restore_id())


def op1_benchmark_hits(spark, sf_dir):
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS pat, least(len(w), 10) AS m
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS pat
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, k, g.m, item FROM g JOIN p USING (pat)),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS at FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

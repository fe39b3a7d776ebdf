"""Operator 8: quality rules with cross-document line frequency.

Rules on one document (words, symbols, repeated lines and windows) are counted in
one pass. Lines are normalised (lower case, single spaces) and hashed; a line in
many distinct documents of its host is template text. Exact copies count as one
document, so a group of copies does not make its own lines template text. Template
lines are removed; a document that keeps too little is rejected.

One digest row per document (hashes, no text) is written once and read by both the
count and the verdict.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text
from voxelspark.llm.text import U64

MIN_DOCS = 20                   # a template line is in so many distinct documents of its host, however large the host is
MIN_WORDS = 10                  # a document keeps so many words
MIN_KEPT = 0.25                 # and this share of its words
BLOCK = 1 << 20                 # bytes of text worked on at once: a worker holds about 100 times as many at its peak
WINDOW = 5
SYMBOLS = text.byte_class(b"#*$%&|<>")
DIGEST = ("doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, content long, line_no array<int>, line_hash array<long>, line_words array<int>")


def _per_text(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return total[hi] - total[lo]


def digest_block(buf: np.ndarray, bounds: np.ndarray) -> dict:
    """Counts of each text of a block, and its lines that have a word."""
    n = len(bounds) - 1
    start, end, of = text.words(buf, bounds)
    at = np.searchsorted(start, bounds)                  # first word of each text
    chars = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    in_words = np.r_[0, np.cumsum(chars[end] - chars[start])]
    symbols = np.r_[0, np.cumsum(SYMBOLS[buf])]

    # lines: the text of each, and its words
    breaks = np.flatnonzero(buf == 10)
    line_from = np.concatenate([bounds[:-1], breaks + 1])
    line_text = np.concatenate([np.arange(n), np.searchsorted(bounds, breaks, "right") - 1])
    order = np.lexsort((line_from, line_text))
    line_from, line_text = line_from[order], line_text[order]
    line_to = np.r_[line_from[1:] - 1, bounds[-1]]
    last = np.r_[line_text[1:] != line_text[:-1], True] if len(line_text) else np.zeros(0, bool)
    line_to[last] = bounds[line_text[last] + 1]
    w0, w1 = np.searchsorted(start, line_from), np.searchsorted(start, line_to)
    number = np.arange(len(line_from)) - np.searchsorted(line_text, line_text)
    some = w1 > w0
    line_from, line_to, line_text, w0, w1, number = (x[some] for x in (line_from, line_to, line_text, w0, w1, number))
    raw = text.Hashes(buf)
    exact = raw(line_from, line_to) ^ text.mix(line_text.astype(U64) + U64(1))
    _, once = np.unique(exact, return_index=True)
    dup = np.ones(len(exact), bool)
    dup[once] = False

    # windows of five words that occur again in their text
    repeat = np.zeros(len(start) + 1, np.int64)
    if len(start) >= WINDOW:
        seq = text.Hashes(raw(start, end))
        window = seq.grams(WINDOW)
        inside = np.flatnonzero(of[:len(window)] == of[WINDOW - 1:])
        h = window[inside] ^ text.mix(of[inside].astype(U64) + U64(1))
        order = np.argsort(h, kind="stable")
        eq = h[order][1:] == h[order][:-1]
        again = inside[order[np.r_[False, eq] | np.r_[eq, False]]] if len(h) else inside
        np.add.at(repeat, again, 1)
        np.add.at(repeat, again + WINDOW, -1)
    repeated = np.r_[0, np.cumsum(np.cumsum(repeat[:-1]) > 0)]

    low = np.frombuffer(buf.tobytes().translate(text.LOWER), np.uint8)
    lower = text.Hashes(text.Hashes(low)(start, end))
    return {"n_words": np.diff(at), "word_chars": _per_text(in_words, at[:-1], at[1:]),
            "n_symbols": _per_text(symbols, bounds[:-1], bounds[1:]),
            "n_dup_lines": np.bincount(line_text[dup], minlength=n),
            "n_repeat_words": _per_text(repeated, at[:-1], at[1:]),
            "content": lower(at[:-1], at[1:]).view(np.int64), "line_at": np.searchsorted(line_text, np.arange(n + 1)),
            "line_no": number, "line_hash": lower(w0, w1).view(np.int64), "line_words": w1 - w0}


def digests(docs: DataFrame, host_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(exchange.NO_ID)).alias("doc_id"),
                       F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for block in text.blocks(batches, limit=BLOCK):
            d = digest_block(*text.utf8(block.column("text")))
            at = pa.array(d["line_at"], pa.int32())
            lists = {k: pa.ListArray.from_arrays(at, pa.array(d[k], t)) for k, t in
                     (("line_no", pa.int32()), ("line_hash", pa.int64()), ("line_words", pa.int32()))}
            plain = {k: pa.array(d[k], pa.int64()) for k in
                     ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content")}
            cols = {"doc_id": block.column("doc_id"), "host": block.column("host").cast(pa.string())} | plain | lists
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
    return docs.mapInArrow(run, DIGEST)


def template_lines(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``host, line``: lines in too many distinct documents of their host."""
    return (rows.select("host", "content", F.explode(F.array_distinct("line_hash")).alias("line"))
            .distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") >= min_docs).select("host", "line"))


def quality(docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS,
            min_words: int = MIN_WORDS, min_kept: float = MIN_KEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``template_lines`` (line numbers from 0 to
    remove), ``kept_words`` and ``kept``.

    Null texts have no words and fail; null hosts are one host named ''. Rows are judged one by one:
    repeated rows and ids get a row each. An empty table gives no rows; other columns are ignored."""
    rows = exchange.cut_lineage(digests(docs, host_col, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    gone = (rows.select("row", "host", F.explode(F.arrays_zip("line_no", "line_hash", "line_words")).alias("l"))
            .select("row", "host", F.col("l.line_hash").alias("line"), F.col("l.line_no").alias("no"), F.col("l.line_words").alias("words"))
            .join(template_lines(rows, min_docs), ["host", "line"])
            .groupBy("row").agg(F.sort_array(F.collect_list("no")).alias("template_lines"), F.sum("words").alias("lost")))
    rows = rows.join(gone, "row", "left")
    kept_words = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    enough = (kept_words >= min_words) & (kept_words >= min_kept * F.col("n_words"))
    return rows.select(exchange.restore_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), F.coalesce("template_lines", F.array().cast("array<int>")).alias("template_lines"),
                       kept_words.alias("kept_words"), (~failed & enough).alias("kept"))


def op8_line_frequency(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
b AS (SELECT r, doc_id, host, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
l0 AS (SELECT r, host, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT r, host, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+'), ' ') AS norm FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
g AS (SELECT r, k, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (
          SELECT r, unnest(range(k, k + 5)) AS pos FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
c AS (SELECT r, host, md5(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS content FROM b),
tpl AS (SELECT l.host, norm FROM l JOIN c USING (r) GROUP BY l.host, norm HAVING count(DISTINCT content) >= 20),
lost AS (SELECT r, sum(len(string_split(norm, ' '))) AS lost FROM l SEMI JOIN tpl USING (host, norm) GROUP BY r),
f AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words - coalesce(lost, 0) AS left_words
      FROM b LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND left_words >= 10 AND left_words >= 0.25 * n_words AS kept FROM v
"""

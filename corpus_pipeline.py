"""The training-data pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes all its predecessor kept. Decisions come as facts by row; what a stage
changes is joined back to the texts: as a broadcast while the facts are few (counted first),
else by a shuffle. Rows that share an id are documents of their own (``unique_ids``), so no
verdict on one holds for another. Null texts are empty, null ids come first, texts of any
length are read whole, further columns are passed on, and an empty table stays empty.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm.decontaminate import decontaminate
from voxelspark.llm.exchange import FEW, NO_ID, cut_lineage, shared_folder, unique_ids
from voxelspark.llm.forest import near_duplicates
from voxelspark.llm.linejoin import similar_lines
from voxelspark.llm.packing import pack
from voxelspark.llm.quality import quality

MIN_WORDS = 10                  # a document that loses lines keeps so many words, or goes


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """Documents with a unique number, and the names of that column and of one for facts, new to the table."""
    taken = {c.lower() for c in docs.columns}
    key, fact = (next(n for i in range(len(taken) + 1) if (n := f"{name}{i}") not in taken) for name in ("row_key", "row_fact"))
    return unique_ids(docs, "doc_id", "text", key), key, fact


def _with_facts(docs: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Documents joined with facts, one row a key."""
    facts = cut_lineage(facts.withColumn(key, F.coalesce("doc_id", F.lit(NO_ID))).drop("doc_id"))
    return docs.join(F.broadcast(facts) if facts.count() <= FEW else facts, key, how)


def _without_lines(docs: DataFrame, gone: str) -> DataFrame:
    """The documents without the lines numbered in the column ``gone``."""
    lines = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull() | (F.size(gone) == 0), F.col("text")).otherwise(F.array_join(lines, "\n"))
    cut = docs.withColumn("text", text)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, template lines are cut from the others.

    A line in ``MIN_DOCS`` distinct documents of its host is template text however large the host is."""
    rows, key, gone = _keyed(docs)
    facts = quality(rows, id_col=key).select("doc_id", F.when(F.col("kept"), F.col("template_lines")).alias(gone))
    facts = facts.filter(F.col(gone).isNull() | (F.size(gone) > 0)).withColumn(gone, F.coalesce(gone, F.array(F.lit(-1))))
    out = _with_facts(rows, facts, key).filter(F.col(gone).isNull() | ~F.array_contains(gone, -1))
    return _without_lines(out, gone).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line makes redundant are cut; a document that loses lines and keeps few words goes."""
    rows, key, gone = _keyed(docs)
    facts = similar_lines(rows, id_col=key).select("doc_id", F.col("removed").alias(gone)).filter(F.size(gone) > 0)
    out = _without_lines(_with_facts(rows, facts, key), gone)
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return out.filter(F.col(gone).isNull() | (words >= MIN_WORDS)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    rows, key, _ = _keyed(docs)
    facts = near_duplicates(rows, id_col=key).filter(~F.col("kept")).select("doc_id")
    return _with_facts(rows, facts, key, "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark item go."""
    rows, key, _ = _keyed(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _with_facts(rows, found.filter("n_hit > 0").select("doc_id"), key, "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("best-fit packing", best_fit_packing)]

#: Similarity joins, components and a tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

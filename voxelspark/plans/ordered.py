"""Order-dependent results within a group, without one task per group.

A plain window over a hot group runs in a single task. Here every group is cut
into buckets that follow the order; the window runs inside a bucket and only one
row per bucket takes part in the second level. A bucket is either an expression
(a time slice, a z plane, a block of sequence numbers) or, with ``bucket=None``,
the range partition a row falls into: sampled boundaries cut a hot group into
many buckets whatever its values are. The assignment is written before use, so a
recomputed task can never see other boundaries.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelspark.session import cut_lineage, grid_partitions


def _parts(keys, order):
    keys = list(keys)
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order)
    outer = W.partitionBy(*keys).orderBy("_bucket")
    return keys, inner, outer


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence) -> DataFrame:
    if bucket is not None:
        return df.withColumn("_bucket", bucket)
    ranged = df.repartitionByRange(grid_partitions(df.sparkSession), *keys, *order)
    return cut_lineage(ranged.withColumn("_bucket", F.spark_partition_id()))


def _with_bucket_facts(df: DataFrame, facts: DataFrame, keys) -> DataFrame:
    join = [df[k].eqNullSafe(facts[k]) for k in (*keys, "_bucket")]
    cond = join[0]
    for c in join[1:]:
        cond = cond & c
    out = df.join(facts, cond, "left")
    for k in (*keys, "_bucket"):
        out = out.drop(facts[k])
    return out


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence,
                out: str = "rn") -> DataFrame:
    """``row_number()`` per ``keys`` (1-based). ``bucket`` must not decrease along ``order``."""
    df = _bucketed(df, keys, bucket, order)
    keys, inner, outer = _parts(keys, order)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*keys, "_bucket",
                         (F.sum("_n").over(outer) - F.col("_n")).alias("_before"))
    ranked = df.withColumn("_rn", F.row_number().over(inner))
    return (_with_bucket_facts(ranked, sizes, keys)
            .withColumn(out, (F.col("_rn") + F.col("_before")).cast("long"))
            .drop("_bucket", "_rn", "_before"))


def carry_last(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence,
               columns: dict[str, Column]) -> DataFrame:
    """Per output name, the last non-null value of the column up to and including the row."""
    df = _bucketed(df, keys, bucket, order)
    keys, inner, outer = _parts(keys, order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    before = outer.rowsBetween(W.unboundedPreceding, -1)
    values = {f"_v_{n}": c for n, c in columns.items()}
    df = df.withColumns(values)
    pos = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    ends = df.groupBy(*keys, "_bucket").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), pos)).alias(f"_e{v}") for v in values])
    ends = ends.select(*keys, "_bucket",
                       *[F.last(f"_e{v}", ignorenulls=True).over(before).alias(f"_c{v}")
                         for v in values])
    df = df.withColumns({f"_i{v}": F.last(v, ignorenulls=True).over(upto) for v in values})
    joined = _with_bucket_facts(df, ends, keys)
    joined = joined.withColumns({n: F.coalesce(f"_i_v_{n}", f"_c_v_{n}") for n in columns})
    return joined.drop("_bucket", *values, *[f"_i{v}" for v in values],
                       *[f"_c{v}" for v in values])


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence,
                columns: dict[str, Column], totals: bool = False) -> DataFrame:
    """Per output name, the sum of the column up to and including the row.

    With ``totals`` the sum over the whole group is added as ``<name>_total``.
    """
    df = _bucketed(df, keys, bucket, order)
    keys, inner, outer = _parts(keys, order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    before = outer.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({f"_v_{n}": c for n, c in columns.items()})
    ends = df.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in columns])
    ends = ends.select(*keys, "_bucket",
                       *[F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)).alias(f"_c_{n}")
                         for n in columns],
                       *[F.sum(f"_e_{n}").over(W.partitionBy(*keys)).alias(f"{n}_total")
                         for n in columns if totals])
    df = df.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(upto) for n in columns})
    joined = _with_bucket_facts(df, ends, keys)
    joined = joined.withColumns({n: F.col(f"_i_{n}") + F.col(f"_c_{n}") for n in columns})
    drop = [f"_{p}_{n}" for p in "vic" for n in columns]
    return joined.drop("_bucket", *drop)


def next_value(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence,
               columns: dict[str, Column]) -> DataFrame:
    """Per output name, the column's value on the following row (null on the last one)."""
    df = _bucketed(df, keys, bucket, order)
    keys, inner, outer = _parts(keys, order)
    pos = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    df = df.withColumns({f"_v_{n}": c for n, c in columns.items()})
    heads = df.groupBy(*keys, "_bucket").agg(
        *[F.min_by(F.struct(f"_v_{n}"), pos).alias(f"_h_{n}") for n in columns])
    heads = heads.select(*keys, "_bucket",
                         *[F.lead(f"_h_{n}").over(outer).alias(f"_c_{n}") for n in columns])
    df = df.withColumns({f"_i_{n}": F.lead(F.struct(f"_v_{n}")).over(inner) for n in columns})
    joined = _with_bucket_facts(df, heads, keys)
    joined = joined.withColumns(
        {n: F.coalesce(f"_i_{n}", f"_c_{n}").getField(f"_v_{n}") for n in columns})
    return joined.drop("_bucket", *[f"_{p}_{n}" for p in "vic" for n in columns])

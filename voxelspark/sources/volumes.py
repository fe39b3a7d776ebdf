"""Voxel and label tables on disk."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.operators.blocks import BLOCK_KEYS, voxels_of
from voxelspark.operators.resample import resample_nearest
from voxelspark.session import ARRAYS_AT_ONCE

BUCKETS = 64
SLAB = 32
SORTED = 1 << 22                # voxels of blocks that a task sorts, so that none are spilled


def _bucket(scan_id, buckets: int):
    return F.pmod(F.xxhash64(scan_id), F.lit(buckets)).cast("int")


def write_volumes(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Parquet in scan buckets, sorted so that row groups cover small coordinate ranges.

    The number of buckets is part of the path, so readers need not know it. Tasks are cut by
    scan and slab of planes: a large scan is written by many tasks, a small one by few. Array blocks
    are dealt out as such and become rows, of the one array they hold, in the task that writes them.
    """
    if "shape" in df.columns:
        value, = (c for c in df.columns if c not in (*BLOCK_KEYS, "shape"))
        n = F.col("shape")
        total = df.agg(F.sum(n[0].cast("long") * n[1] * n[2])).first()[0] or 0
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, total // SORTED)
        dealt = df.repartition(tasks, _bucket(F.col("scan_id"), buckets), "scan_id", "z0")
        rows = voxels_of(dealt, value).withColumn("buckets", F.lit(buckets)).withColumn("bucket", _bucket(F.col("scan_id"), buckets))
        rows.sortWithinPartitions("bucket", "scan_id", "z", "y", "x").write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)
        return
    _write(df, path, buckets, F.floor(F.col("z") / SLAB), ["z", "y", "x"])


def _write(df: DataFrame, path: str, buckets: int, slab, place: Sequence[str], **options) -> None:
    out = df.withColumn("buckets", F.lit(buckets)).withColumn("bucket", _bucket(F.col("scan_id"), buckets))
    out.repartition("bucket", "scan_id", slab).sortWithinPartitions("bucket", "scan_id", *place).write.mode("overwrite").options(**options).partitionBy(
        "buckets", "bucket").parquet(path)


def write_blocks(blocks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Array blocks (``operators.blocks``) in scan buckets: a task holds one layer of one scan's blocks."""
    _write(blocks, path, buckets, F.col("z0"), ["z0", "y0", "x0"], **ARRAYS_AT_ONCE)


def read_blocks(spark: SparkSession, path: str, scan_ids: Sequence[int] | None = None,
                box: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Array blocks, optionally only of some scans (prunes folders) and those that reach into a half-open box (z, y, x)."""
    df = read_volumes(spark, path, scan_ids)
    for i, (a, (lo, hi)) in enumerate(zip("zyx", box or ())):
        df = df.filter((F.col(f"{a}0") < hi) & (F.col(f"{a}0") + F.col("shape")[i] > lo))
    return df


def read_volumes(spark: SparkSession, path: str, scan_ids: Sequence[int] | None = None,
                 z_range: tuple[int, int] | None = None, buckets: int | None = None) -> DataFrame:
    """The table, optionally only some scans (prunes folders) and planes (prunes row groups).

    ``buckets``, if given, must be what the table was written with."""
    df = spark.read.parquet(path)
    if scan_ids is not None or buckets is not None:
        row = df.select("buckets").first()
        written = row[0] if row else buckets or BUCKETS
        if buckets not in (None, written):
            raise ValueError(f"{path} has {written} buckets, not {buckets}")
        if scan_ids is not None:
            wanted = F.lit(written)
            folders = F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(int(i)).cast("long")), wanted).cast("int") for i in scan_ids]))
            found = spark.range(1).select(folders.alias("f")).first()[0]      # at most one folder a scan asked for
            df = df.filter(F.col("bucket").isin(found) & F.col("scan_id").isin([int(i) for i in scan_ids]))
    if z_range is not None:
        df = df.filter((F.col("z") >= z_range[0]) & (F.col("z") < z_range[1]))
    return df.drop("bucket", "buckets")


def write_labels(labels: DataFrame, grid: DataFrame, source: DataFrame, path: str, label: str = "label") -> None:
    """Labels on the scans' own full frames; outside a crop there is simply nothing (background)."""
    write_volumes(resample_nearest(labels, grid, source, label), path)

"""Sliding windows over rows of voxels: tiles that cover a voxel, arg-max, fields, timings.

Scoring and blending work on array blocks (``operators.blocks``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.geometry import SIZE
from voxelspark.functions.tiling import OVERLAP, covering_starts
from voxelspark.plans.attach import attach

KEYS = ["scan_id", "z", "y", "x"]
TILE_KEYS = ["scan_id", "tz", "ty", "tx"]


def tile_voxels(voxels: DataFrame, scans: DataFrame, tile: Sequence[int], overlap: float = OVERLAP) -> DataFrame:
    """Every voxel once per tile that covers it: tile start t*, offset d*.

    The covering starts follow from arithmetic on the position; there is no
    join with the tile list.
    """
    rows = attach(voxels, scans.select("scan_id", *SIZE), sized_by=scans)
    for a, t in zip("zyx", tile):
        rows = rows.withColumn(f"t{a}", F.explode(covering_starts(F.col(a), F.col(f"n{a}"), t, overlap)))
    rest = [c for c in voxels.columns if c not in KEYS]
    return rows.select(*TILE_KEYS, *[(F.col(a) - F.col(f"t{a}")).alias(f"d{a}") for a in "zyx"], *rest)


def argmax_label(logits: DataFrame, logit: str = "logit") -> DataFrame:
    """Class with the largest logit, the lowest on ties."""
    at = F.array_position(logit, F.array_max(logit)) - 1
    return logits.select(*KEYS, at.cast("short").alias("label"))


def signed_field(logits: DataFrame, logit: str = "logit") -> DataFrame:
    """Per class its logit minus the best of the others; zero on the arg-max boundary."""
    top = F.sort_array(logit, asc=False)
    out = logits.withColumn("_top", F.slice(top, 1, 2))
    best, second = F.col("_top")[0], F.col("_top")[1]
    field = F.transform(logit, lambda v: v - F.when(v == best, second).otherwise(best))
    return out.select(*KEYS, field.alias("field"))


def silence_outside(field: DataFrame, mask: DataFrame, value: str = "field") -> DataFrame:
    """-1 where the field is positive but the cleaned mask has no voxel."""
    marked = field.join(mask.select(*KEYS).distinct().withColumn("_in", F.lit(True)), KEYS, "left")
    drop = F.col("_in").isNull() & (F.col(value) > 0)
    return marked.select(*KEYS, F.when(drop, F.lit(-1.0)).otherwise(F.col(value)).alias(value))


def tile_timing(tile_log: DataFrame) -> DataFrame:
    """Per run: first tile apart (it includes warm-up), mean and slowest of the rest, where it failed.

    ``tile_log``: run_id, tile (1-based), seconds, failed.
    """
    rest = F.when((F.col("tile") > 1) & ~F.col("failed"), F.col("seconds"))
    done = F.when(~F.col("failed"), F.col("tile"))
    return tile_log.groupBy("run_id").agg(
        F.count(done).alias("tiles"),
        F.max(F.when((F.col("tile") == 1) & ~F.col("failed"), F.col("seconds"))).alias("first_seconds"),
        F.avg(rest).alias("mean_seconds"), F.max(rest).alias("slowest_seconds"),
        F.min(F.when(F.col("failed"), F.col("tile"))).alias("failed_tile"))

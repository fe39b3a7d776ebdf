"""Neighbourhood operators on sparse labels: runs, dilation, contacts, nearest label."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelspark.functions.geometry import AXES, SIZE
from voxelspark.plans.attach import attach

# Fixed values.
DILATE_RADIUS = 3
ASSIGN_MM = 2.0


def x_runs(mask: DataFrame, *extra: str) -> DataFrame:
    """Maximal runs x0..x1 along x, per scan, z, y and the ``extra`` columns."""
    keys = ["scan_id", *extra, "z", "y"]
    start = F.col("x") - F.row_number().over(W.partitionBy(*keys).orderBy("x"))
    return (mask.select(*keys, "x", start.alias("_run")).groupBy(*keys, "_run")
            .agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run"))


def ball_rows(radius: int) -> list[tuple[int, int, int]]:
    """(dz, dy, half width in x) of the digital ball with d^2 <= (radius + 1/2)^2."""
    limit = (radius + 0.5) ** 2
    return [(dz, dy, math.isqrt(int(limit - dz * dz - dy * dy)))
            for dz in range(-radius, radius + 1) for dy in range(-radius, radius + 1)
            if dz * dz + dy * dy <= limit]


def dilate(mask: DataFrame, scans: DataFrame, radius: int = DILATE_RADIUS) -> DataFrame:
    """Voxels within the ball of a mask voxel, inside the frame.

    Works on x runs: a run meets one row of the ball per (dz, dy), so a run of
    any length costs the same, and overlaps are merged as intervals instead of
    deduplicating voxels.
    """
    rows = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("half"))
                     for a, b, c in ball_rows(radius)])
    grown = x_runs(mask).withColumn("b", F.explode(rows)).select(
        "scan_id", (F.col("z") + F.col("b.dz")).alias("z"), (F.col("y") + F.col("b.dy")).alias("y"),
        (F.col("x0") - F.col("b.half")).alias("x0"), (F.col("x1") + F.col("b.half")).alias("x1"))
    grown = attach(grown, scans.select("scan_id", *SIZE), sized_by=scans)
    grown = grown.filter(F.col("z").between(0, F.col("nz") - 1) & F.col("y").between(0, F.col("ny") - 1)).select(
        "scan_id", "z", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("nx") - 1).alias("x1"))
    line = W.partitionBy("scan_id", "z", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1))
    grown = grown.withColumn("_new", F.coalesce((F.col("x0") > reach + 1).cast("int"), F.lit(1)))
    grown = grown.withColumn("_island", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    merged = grown.groupBy("scan_id", "z", "y", "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return merged.select("scan_id", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def _faces(axis: str, label: str) -> list[Column]:
    """Directed faces of a voxel along one axis as (a, b) structs; null where there is none."""
    others = [a for a in "zyx" if a != axis]
    line = W.partitionBy("scan_id", *others).orderBy(axis)
    at, own = F.col(axis), F.col(label).cast("int")
    met = F.when(F.lead(axis).over(line) == at + 1, F.lead(label).over(line).cast("int"))
    met = F.when(at + 1 < F.col(f"n{axis}"), F.coalesce(met, F.lit(0)))
    back = F.coalesce(F.lag(axis).over(line) == at - 1, F.lit(False))
    face = lambda a, b: F.struct(a.alias("a"), b.alias("b"))                        # noqa: E731
    return [F.when(met != own, face(own, met)), F.when((met != own) & (met > 0), face(met, own)),
            F.when((at > 0) & ~back, face(own, F.lit(0)))]


def contacts(labels: DataFrame, scans: DataFrame, label: str = "label") -> DataFrame:
    """Directed face counts ``scan_id, a, b, faces`` between different labels.

    ``b`` = 0 is background; a label's shell is the sum over all its ``b``. Faces
    on the border of the frame do not count. Neighbours come from line windows
    (two shuffles for three axes), not from joins.
    """
    rows = attach(labels.select("scan_id", "z", "y", "x", label), scans.select("scan_id", *SIZE), sized_by=scans)
    rows = rows.repartition("scan_id", "z")
    for axis in "xyz":
        rows = rows.withColumn(f"_f{axis}", F.array(*_faces(axis, label)))
    pairs = rows.select("scan_id", F.explode(F.array_compact(F.concat("_fx", "_fy", "_fz"))).alias("f"))
    return pairs.groupBy("scan_id", "f.a", "f.b").agg(F.count(F.lit(1)).alias("faces"))


def nearest_label(seeds: DataFrame, targets: DataFrame, scans: DataFrame, radius_mm: float = ASSIGN_MM,
                  label: str = "label") -> DataFrame:
    """For every target, the nearest seed within ``radius_mm``: ``distance`` and ``near``.

    Lowest label on equal distances; targets with no seed in reach are absent.
    The minimum of squared distances separates by axis, so three passes of at
    most 2r+1 copies replace one of a whole ball.
    """
    facts = scans.select("scan_id", "spacing", *SIZE)
    rows = seeds.select("scan_id", "z", "y", "x", F.struct(F.lit(0.0).alias("d2"), F.col(label).cast("int").alias("near")).alias("best"))
    limit = radius_mm * radius_mm + 1e-9
    rows = rows.repartition("scan_id", "z")
    for i, axis in enumerate(AXES):
        rows = attach(rows, facts, sized_by=scans)
        s, at = F.col("spacing")[i], F.col(axis)
        reach = F.floor(F.lit(radius_mm + 1e-9) / s).cast("int")
        around = F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.col(SIZE[i]) - 1))
        rows = rows.withColumn("_t", F.explode(around))
        step = (F.col("_t") - at) * s
        d2 = F.col("best.d2") + step * step
        keys = [F.col("_t").alias(a) if a == axis else F.col(a) for a in "zyx"]
        rows = rows.select("scan_id", *keys, F.struct(d2.alias("d2"), F.col("best.near").alias("near")).alias("best"))
        rows = rows.filter(F.col("best.d2") <= limit).groupBy("scan_id", "z", "y", "x").agg(F.min("best").alias("best"))
    hit = targets.join(rows, ["scan_id", "z", "y", "x"])
    return hit.select(*targets.columns, F.sqrt("best.d2").alias("distance"), F.col("best.near").alias("near"))

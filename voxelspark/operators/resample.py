"""Resampling along grid lines.

Each axis is handled within lines of voxels, all in slabs of planes that are shuffled once.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelspark.functions.geometry import AXES, GRID_SPACING_MM, SIZE, box_image, frame_map, grid_size
from voxelspark.plans.attach import attach

# Fixed values.
OUTSIDE_HU = -1000.0
PREVIEW_SPACING_MM = 1.0
PREVIEW_SIGMA_MM = 0.6
SLAB = 8                         # source planes that are resampled together
EDGE = 1e-9                      # of a voxel: what counts as exactly half way


def resampled_headers(scans: DataFrame, spacing: float = GRID_SPACING_MM) -> DataFrame:
    """Headers of the isotropic grid: same origin and direction."""
    sizes = {n: grid_size(F.col(n), F.col("spacing")[i], spacing) for i, n in enumerate(SIZE)}
    return scans.select("scan_id", *[c.alias(n) for n, c in sizes.items()],
                        F.array_repeat(F.lit(float(spacing)), 3).alias("spacing"), "origin", "direction")


def _slabs(scans: DataFrame, spacing: float) -> DataFrame:
    """A row per scan and slab: sizes ``_n*`` and ``_m*`` and spacings ``_s*`` of the three axes."""
    facts = {}
    for i, a in enumerate(AXES):
        s = F.col("spacing")[i]
        facts |= {f"_n{a}": F.col(SIZE[i]), f"_s{a}": s, f"_m{a}": grid_size(F.col(SIZE[i]), s, spacing)}
    each = F.explode(F.sequence(F.lit(0), F.floor((F.col("nz") - 1) / SLAB).cast("int")))
    return scans.select("scan_id", each.alias("_slab"), *[c.alias(n) for n, c in facts.items()])


def _targets(rows: DataFrame, axis: str, spacing: float) -> tuple[DataFrame, Callable[[str, Column], Column]]:
    """A row per target of each voxel along one axis, ``_t``; and its value from a column and the next voxel's."""
    at, n, s, m = F.col(axis), F.col(f"_n{axis}"), F.col(f"_s{axis}"), F.col(f"_m{axis}")
    last = at == n - 1
    lo = F.greatest(F.floor(at * s / spacing).cast("int") - 1, F.lit(0))
    hi = F.when(last, m - 1).otherwise(F.least(F.floor((at + 1) * s / spacing).cast("int") + 1, m - 1))
    rows = rows.withColumn("_t", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    p = F.col("_t") * F.lit(spacing) / s
    here = F.floor(p)
    rows = rows.filter((here == at) | (last & (here >= n - 1)))

    def value(v: str, following: Column) -> Column:
        return (F.when(p >= n - 0.5, F.lit(OUTSIDE_HU)).when(last, F.col(v)).otherwise(F.col(v) + (following - F.col(v)) * (p - here)))
    return rows, value


def resample_linear(voxels: DataFrame, scans: DataFrame, spacing: float = GRID_SPACING_MM) -> DataFrame:
    """Trilinear resampling of dense volumes to an isotropic grid.

    Positions up to half a voxel beyond the last centre take the edge value,
    positions further out are air. A voxel emits exactly the targets between it
    and its next neighbour, so no target grid is generated or joined. The one
    shuffle is of the source: a slab of planes goes together with the plane above
    it, and every row carries the value above its own through the x and y passes.
    """
    slab = F.floor(F.col("z") / SLAB).cast("int")
    below = (F.col("z") % SLAB == 0) & (F.col("z") > 0)
    rows = voxels.select("scan_id", "z", "y", "x", "hu", F.explode(F.when(below, F.array(slab - 1, slab)).otherwise(F.array(slab))).alias("_slab"))
    part = ["scan_id", "_slab"]
    rows = rows.repartition(*part).join(_slabs(scans, spacing), part).withColumn("v", F.col("hu").cast("double"))
    rows = rows.withColumn("w", F.lead("v").over(W.partitionBy(*part, "y", "x").orderBy("z"))).filter(slab == F.col("_slab")).drop("hu")
    for axis in "xy":
        line = W.partitionBy(*part, *[a for a in "zyx" if a != axis]).orderBy(axis)
        rows = rows.withColumns({f"_next_{c}": F.lead(c).over(line) for c in "vw"})
        rows, value = _targets(rows, axis, spacing)
        rows = rows.withColumns({c: value(c, F.col(f"_next_{c}")) for c in "vw"}).withColumn(axis, F.col("_t")).drop("_t", "_next_v", "_next_w")
    rows, value = _targets(rows, "z", spacing)
    return rows.select("scan_id", F.col("_t").alias("z"), "y", "x", value("v", F.col("w")).alias("hu"))


def resample_nearest(labels: DataFrame, grid: DataFrame, reference: DataFrame, label: str = "label") -> DataFrame:
    """Sparse labels from ``grid`` back on the ``reference`` frame, never interpolated.

    Every labelled voxel names the reference voxels whose nearest grid voxel it is (the upper
    one on ties): the box its cell covers in the reference, then an exact test. Three short
    ranges per row and no shuffle, whatever the directions of the two frames.
    """
    facts = grid.select("scan_id", F.col("spacing").alias("_gs"), F.col("origin").alias("_go"), F.col("direction").alias("_gd")).join(
        reference.select("scan_id", F.col("spacing").alias("_rs"), F.col("origin").alias("_ro"), F.col("direction").alias("_rd"),
                         *SIZE), "scan_id")
    to_grid = frame_map("_ro", "_rs", "_rd", "_go", "_gs", "_gd")
    to_reference = frame_map("_go", "_gs", "_gd", "_ro", "_rs", "_rd")
    facts = facts.select("scan_id", to_grid[0].alias("_m"), to_grid[1].alias("_c"), to_reference[0].alias("_w"),
                         to_reference[1].alias("_u"), *SIZE)
    rows = attach(labels, facts, sized_by=grid)
    w, u, m, c = (F.col(n) for n in ("_w", "_u", "_m", "_c"))
    low, high = box_image([[w[3 * i + j] for j in range(3)] for i in range(3)], [u[i] for i in range(3)],
                          [F.col(a) - 0.5 for a in AXES], [F.col(a) + 0.5 for a in AXES])
    ends = {}
    for i, a in enumerate(AXES):
        ends[f"_lo_{a}"] = F.greatest(F.ceil(low[i] - EDGE), F.lit(0)).cast("int")
        ends[f"_hi_{a}"] = F.least(F.floor(high[i] + EDGE), F.col(SIZE[i]) - 1).cast("int")
    rows = rows.withColumns(ends)
    for a in AXES:
        rows = rows.filter(F.col(f"_lo_{a}") <= F.col(f"_hi_{a}")).withColumn(f"_t{a}", F.explode(F.sequence(f"_lo_{a}", f"_hi_{a}")))
    t = [F.col(f"_t{a}") for a in AXES]
    for i, a in enumerate(AXES):
        at = m[3 * i] * t[0] + m[3 * i + 1] * t[1] + m[3 * i + 2] * t[2] + c[i]
        rows = rows.filter(F.floor(at + (0.5 + EDGE)) == F.col(a))
    return rows.select("scan_id", *[F.col(f"_t{a}").alias(a) for a in "zyx"], label)

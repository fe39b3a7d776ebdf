"""Moving, cropping and padding voxel tables: narrow operations, no voxel shuffle."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions import geometry as G
from voxelspark.plans.attach import attach


def orient_lps(voxels: DataFrame, scans: DataFrame) -> DataFrame:
    """Voxels re-indexed on the LPS-oriented grid."""
    turned = G.orient_lps_headers(scans).select("scan_id", "axis", "flip", *G.SIZE)
    both = attach(voxels, turned, sized_by=scans)
    x, y, z = G.moved_index(F.col("axis"), F.col("flip"), [F.col(n) for n in G.SIZE],
                            [F.col("x"), F.col("y"), F.col("z")])
    rest = [c for c in voxels.columns if c not in ("scan_id", "z", "y", "x")]
    return both.select("scan_id", z.alias("z"), y.alias("y"), x.alias("x"), *rest)


def crop_to_box(voxels: DataFrame, scans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxels inside each scan's box (``box_lo``/``box_hi`` in mm); scans whose box
    misses the frame are absent (``crop_ranges`` names them)."""
    ranges = G.crop_ranges(scans.join(boxes, "scan_id")).filter("status = 'ok'")
    ranges = ranges.select("scan_id", *[f"{e}{a}" for e in "ab" for a in G.AXES])
    return within(voxels, ranges, sized_by=scans)


def within(voxels: DataFrame, ranges: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """Voxels in the half-open index ranges a*/b* of their scan."""
    both = attach(voxels, ranges, sized_by=sized_by)
    for a in G.AXES:
        both = both.filter((F.col(a) >= F.col(f"a{a}")) & (F.col(a) < F.col(f"b{a}")))
    return both.select(*voxels.columns)


def pad_edge(voxels: DataFrame, scans: DataFrame, tile: Sequence[int]) -> DataFrame:
    """Repeat the last voxel of an axis until the frame is as thick as ``tile`` (z, y, x)."""
    both = attach(voxels, scans.select("scan_id", *G.SIZE), sized_by=scans)
    for a, t in zip("zyx", tile):
        n = F.col(f"n{a}")
        end = F.when(F.col(a) == n - 1, F.greatest(n, F.lit(t)) - 1).otherwise(F.col(a))
        both = both.withColumn(a, F.explode(F.sequence(F.col(a), end)))
    return both.select(*voxels.columns)


def unpad(voxels: DataFrame, scans: DataFrame) -> DataFrame:
    """Undo ``pad_edge``: only indexes inside the frame."""
    both = attach(voxels, scans.select("scan_id", *G.SIZE), sized_by=scans)
    for a in "zyx":
        both = both.filter(F.col(a) < F.col(f"n{a}"))
    return both.select(*voxels.columns)


def fit_box(vertices: DataFrame, margin_mm: float = 3.0) -> DataFrame:
    """Bounding box of each surface plus a margin."""
    return vertices.groupBy("scan_id").agg(
        *[(F.min(a) - margin_mm).alias(f"lo_{a}") for a in G.AXES],
        *[(F.max(a) + margin_mm).alias(f"hi_{a}") for a in G.AXES])


def coverage_ranges(grid: DataFrame, sub: DataFrame, x_range: bool = False) -> DataFrame:
    """Index ranges a*/b* of ``grid`` covered by the axis-parallel ``sub`` box.

    Both hold one row per scan: n*, spacing, origin (``sub`` prefixed ``sub_``).
    A voxel is covered when its centre falls within half a voxel of the sub grid.
    With ``x_range`` the x range is cut to [half_lo, half_hi).
    """
    both = grid.join(sub, "scan_id")
    out = {}
    for i, a in enumerate(G.AXES):
        first = F.col("sub_origin")[i] - F.col("sub_spacing")[i] * 0.5
        last = F.col("sub_origin")[i] + F.col("sub_spacing")[i] * (F.col(f"sub_n{a}") - 0.5)
        lo = F.ceil((first - F.col("origin")[i]) / F.col("spacing")[i])
        hi = F.ceil((last - F.col("origin")[i]) / F.col("spacing")[i])
        out[f"a{a}"] = F.greatest(lo, F.lit(0)).cast("int")
        out[f"b{a}"] = F.least(hi, F.col(f"n{a}")).cast("int")
    if x_range:
        out["ax"] = F.greatest(out["ax"], F.col("half_lo"))
        out["bx"] = F.least(out["bx"], F.col("half_hi"))
    return both.select("scan_id", *[v.alias(k) for k, v in out.items()])


def cropped_headers(ranges: DataFrame) -> DataFrame:
    """Headers of the cropped frames: ``ranges`` holds the header columns and a*/b*."""
    origin = F.array(*G.to_physical([F.col(f"a{a}") for a in G.AXES]))
    return ranges.select("scan_id", *[(F.col(f"b{a}") - F.col(f"a{a}")).alias(f"n{a}") for a in G.AXES],
                         "spacing", origin.alias("origin"), "direction")


def recentred(voxels: DataFrame, ranges: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """Voxels within a*/b*, counted from the corner of the crop."""
    both = attach(voxels, ranges.select("scan_id", *[f"{e}{a}" for e in "ab" for a in G.AXES]), sized_by=sized_by)
    for a in G.AXES:
        both = both.filter((F.col(a) >= F.col(f"a{a}")) & (F.col(a) < F.col(f"b{a}")))
    both = both.withColumns({a: F.col(a) - F.col(f"a{a}") for a in "zyx"})
    return both.select(*voxels.columns)

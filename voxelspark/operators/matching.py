"""Matching intensities to a reference curve, and building that curve."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.operators.crop import within
from voxelspark.operators.measure import bounding_box
from voxelspark.operators.quantiles import quantiles
from voxelspark.plans.attach import attach
from voxelspark.session import cut_lineage

# Fixed values.
LEVELS = 256
MARGIN_VOXELS = 20
MANDIBLE = 1


def match_quantiles(voxels: DataFrame, fractions: Sequence[float], reference: Sequence[float]) -> DataFrame:
    """Map each scan's quantiles onto ``reference`` (one value per fraction); adds ``matched``.

    Monotone and piecewise linear; repeated source knots keep their lowest level;
    values beyond the knots are clamped. Only the knots, at most one per fraction,
    leave the quantile step: they join the voxels as two arrays a scan, and the
    piece is found by halving, so voxels are not shuffled.
    """
    target = F.array(*[F.lit(float(v)) for v in reference])
    knots = quantiles(voxels, ["scan_id"], "hu", fractions)
    knots = knots.groupBy("scan_id", F.col("value").alias("x")).agg(F.min("level").alias("level"))
    pairs = F.array_sort(F.collect_list(F.struct("x", F.element_at(target, F.col("level") + 1).alias("y"))))
    curves = cut_lineage(knots.groupBy("scan_id").agg(pairs.alias("k")).select(
        "scan_id", F.col("k.x").alias("_xs"), F.col("k.y").alias("_ys"), F.size("k").alias("_n")))
    rows = attach(voxels, curves, row_bytes=16 * len(fractions) + 64)
    v = F.least(F.greatest(F.col("hu").cast("double"), F.get("_xs", F.lit(0))), F.get("_xs", F.col("_n") - 1))
    rows = rows.withColumns({"_v": v, "_at": F.lit(0)})
    step = 1 << max(0, len(fractions) - 1).bit_length()
    while step := step >> 1:                             # the last knot at or before the value
        far = F.col("_at") + step
        rows = rows.withColumn("_at", F.when((far < F.col("_n")) & (F.get("_xs", far) <= F.col("_v")), far).otherwise(F.col("_at")))
    x0, y0 = F.get("_xs", "_at"), F.get("_ys", "_at")
    x1, y1 = F.get("_xs", F.col("_at") + 1), F.get("_ys", F.col("_at") + 1)
    matched = F.when(x1.isNull(), y0).otherwise((y1 - y0) / (x1 - x0) * (F.col("_v") - x0) + y0)
    return rows.select(*voxels.columns, matched.alias("matched"))


def reference_curve(voxels: DataFrame, labels: DataFrame, scans: DataFrame, levels: int = LEVELS,
                    margin: int = MARGIN_VOXELS) -> DataFrame:
    """Median over scans of each scan's quantile curve around the mandible.

    Every scan with a jaw counts. Returns ``level, fraction, hu`` (one decimal) and
    ``built_from``; no rows at all means that no scan has one.
    """
    jaw = labels.filter(F.col("label") == MANDIBLE)
    boxes = bounding_box(jaw, scans, by=["scan_id"], margin=margin).drop("voxels")
    crop = within(voxels, boxes, sized_by=scans)
    curves = quantiles(crop, ["scan_id"], "hu", [i / levels for i in range(levels + 1)])
    middle = quantiles(curves.select(F.col("level").alias("at"), "value"), ["at"], "value", [0.5])
    used = curves.groupBy(F.col("level").alias("at")).agg(F.count(F.lit(1)).alias("built_from"))
    return middle.join(used, "at").select(
        F.col("at").alias("level"), (F.col("at") / levels).alias("fraction"),
        F.bround("value", 1).alias("hu"), "built_from")

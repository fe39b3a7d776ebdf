"""The field of view, histograms and the two automatic thresholds."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelspark.operators.quantiles import FEW, bin_of, extents, quantiles
from voxelspark.plans.attach import attach
from voxelspark.session import cut_lineage

# Fixed values.
BINS = 256
MARGIN_SCALE = 100.0
TOP_FRACTION = 0.995


def inside_fov(voxels: DataFrame) -> DataFrame:
    """Voxels above the padding value (minimum + 1); every voxel of a scan where none is."""
    low = extents(voxels, ["scan_id"], "hu").withColumnRenamed("high", "top")
    floor = F.when(F.col("top") > F.col("low") + 1, F.col("low") + 1).otherwise(F.lit(float("-inf")))
    facts = cut_lineage(low.select("scan_id", floor.alias("floor")))
    return attach(voxels, facts).filter(F.col("hu") > F.col("floor")).select(voxels.columns)


def histogram(voxels: DataFrame, ends: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width histogram per scan, at most ``bins`` rows each, combined in every task.

    The top edge is pushed out by 1/100 of a bin so that the maximum falls inside.
    """
    span = F.col("high") - F.col("low")
    facts = ends.select("scan_id", "low", ((span + span / bins / MARGIN_SCALE) / bins).alias("bin_width"))
    v = F.col("hu").cast("double")
    rows = attach(voxels.select("scan_id", v.alias("hu")).filter(v.isNotNull() & ~F.isnan(v)), facts, row_bytes=64, salt_by=("hu",))
    at = bin_of(F.col("hu"), F.col("low"), F.col("bin_width"), bins)
    return rows.groupBy("scan_id", F.col("low").alias("first"), "bin_width", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def best_split(counts: np.ndarray) -> tuple[int, int]:
    """Two cut bins i < j that maximise the between-class variance (first on ties).

    Means are taken over bin numbers, which changes neither order nor ties, and
    keeps every sum an exact integer.
    """
    n = len(counts)
    w = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts * np.arange(n))]).astype(float)

    def part(a, b):
        weight, total = w[b] - w[a], s[b] - s[a]
        return np.divide(total * total, weight, out=np.zeros_like(weight), where=weight > 0)

    cut = np.arange(1, n)
    score = part(0 * cut, cut)[:, None] + part(cut[:, None], cut[None, :]) + part(cut, 0 * cut + n)[None, :]
    score[cut[:, None] >= cut[None, :]] = -1.0
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    return int(i), int(j)


def _cut_bins(hist: pd.Series) -> pd.Series:
    """The two cuts, the bin of the ``TOP_FRACTION`` quantile, values in it or above, and all values."""
    def cuts(counts):
        upto = np.cumsum(counts)
        top = int(np.searchsorted(upto, np.floor(TOP_FRACTION * (upto[-1] - 1)), side="right"))
        return [*best_split(counts), top, int(upto[-1] - upto[top] + counts[top]), int(upto[-1])]
    return hist.map(lambda h: cuts(np.asarray(h, dtype=np.int64)))


def _top(voxels: DataFrame, cuts: DataFrame, ends: DataFrame, bins: int) -> DataFrame:
    """The ``TOP_FRACTION`` quantile per scan, from the values in its bin or above; these are sorted if they are few."""
    facts = cuts.select("scan_id", "first", "bin_width", F.col("c")[2].alias("top"), F.col("c")[3].alias("kept"), F.col("c")[4].alias("rows"))
    v = F.col("hu").cast("double")
    rows = voxels.select("scan_id", (v + F.lit(0.0)).alias("hu")).filter(v.isNotNull() & ~F.isnan(v))           # one zero
    rows = attach(rows, facts.filter(F.col("kept") <= FEW), row_bytes=64, salt_by=("hu",))
    rows = rows.filter(bin_of(F.col("hu"), F.col("first"), F.col("bin_width"), bins) >= F.col("top"))
    one = rows.groupBy("scan_id", "kept", "rows").agg(F.sort_array(F.collect_list("hu")).alias("vs"))
    p = F.lit(TOP_FRACTION) * (F.col("rows") - 1)
    low, high = (F.get("vs", (f(p) - (F.col("rows") - F.col("kept"))).cast("int")) for f in (F.floor, F.ceil))
    few = one.select("scan_id", (low + (high - low) * (p - F.floor(p))).alias("value"))
    many = facts.filter(F.col("kept") > FEW).select("scan_id")
    if many.isEmpty():
        return few
    rest = quantiles(attach(voxels, many, row_bytes=64, salt_by=("hu",)), ["scan_id"], "hu", [TOP_FRACTION], ends=ends.join(many, "scan_id"))
    return few.unionByName(rest.select("scan_id", "value"))


def otsu_thresholds(voxels: DataFrame, bins: int = BINS) -> DataFrame:
    """Per scan ``low``, ``auto`` (upper bin edges of the two cuts) and ``high``.

    ``high`` is the 99.5th percentile, at least ``auto + 1``. Voxels are read three
    times, into sums of some rows a scan; none is shuffled but those near ``high``.
    """
    cut_bins = F.pandas_udf(_cut_bins, T.ArrayType(T.LongType()))
    ends = cut_lineage(extents(voxels, ["scan_id"], "hu"))
    hist = histogram(voxels, ends, bins)
    filled = hist.groupBy("scan_id", "first", "bin_width").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    arrays = filled.select("scan_id", "first", "bin_width", F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("m")[b], F.lit(0))).alias("h"))
    cuts = cut_lineage(arrays.select("scan_id", "first", "bin_width", cut_bins("h").alias("c")))
    edge = [F.col("first") + F.col("bin_width") * (F.col("c")[i] + 1) for i in (0, 1)]
    found = cuts.select("scan_id", edge[0].alias("low"), edge[1].alias("auto"))
    return found.join(_top(voxels, cuts, ends, bins), "scan_id").select(
        "scan_id", "low", "auto", F.greatest(F.col("value"), F.col("auto") + 1.0).alias("high"))

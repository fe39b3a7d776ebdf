"""The kept preview: a coarse grid and its thresholds, queried again without the scan."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.functions.intensity import DEFAULT_DENSITY, density_to_threshold
from voxelspark.operators.blocks import BLOCK_KEYS
from voxelspark.plans.attach import attach
from voxelspark.sources.volumes import read_volumes, write_volumes

# Fixed value.
GONE = "the preview data is gone: build the preview again"


def save_preview(grid: DataFrame, thresholds: DataFrame, path: str) -> None:
    """Intensities rounded to 16 bits, and low/auto/high per scan. ``grid``: rows, or blocks, whose voxels are shuffled as such."""
    if "shape" in grid.columns:
        write_volumes(grid.select(*BLOCK_KEYS, "shape", F.transform("hu", lambda v: F.rint(v).cast("short")).alias("hu")), f"{path}/grid")
    else:
        write_volumes(grid.select("scan_id", "z", "y", "x", F.rint("hu").cast("short").alias("hu")), f"{path}/grid")
    thresholds.select("scan_id", "low", "auto", "high").write.mode("overwrite").parquet(f"{path}/thresholds")


def preview_mask(spark: SparkSession, path: str, density: float = DEFAULT_DENSITY) -> DataFrame:
    """Voxels above the threshold that ``density`` (0..100) means for each scan."""
    try:
        grid, levels = read_volumes(spark, f"{path}/grid"), spark.read.parquet(f"{path}/thresholds")
    except AnalysisException as e:
        raise RuntimeError(GONE) from e
    cut = levels.select("scan_id", density_to_threshold(F.lit(density), F.col("low"), F.col("auto"),
                                                        F.col("high")).alias("threshold"))
    return attach(grid, cut).filter(F.col("hu") > F.col("threshold"))

"""Choosing a model configuration, and auditing installed files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.functions.intensity import CLIP, MEAN, STD
from voxelspark.functions.tiling import DIVISOR, OVERLAP, TILE

# Fixed value.
NOT_FOUND = "no configuration with the preprocessing parameters found"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def load_config(candidates: DataFrame) -> DataFrame:
    """Per run the first existing candidate in order of ``priority``; an error if none exists.

    ``candidates``: run_id, priority, path, present, config.
    """
    at = F.when(F.col("present"), F.struct("priority", "path", "config"))
    best = candidates.groupBy("run_id").agg(F.min(at).alias("b"))
    return best.select("run_id", "b.path", "b.config", F.when(F.col("b").isNull(), NOT_FOUND).alias("error"))


SETTINGS = ("tile array<int>, tile_divisor array<int>, overlap double, num_classes int, "
            "normalization struct<clip: array<double>, mean: double, std: double>")


def settings(chosen: DataFrame) -> DataFrame:
    """What a scorer needs of its configuration (``config``, JSON text), one row each; what is not given has its usual value.

    Adds tile, divisor (z, y, x), overlap, num_classes, lo, hi, mean, std; other columns stay.
    """
    c = F.from_json("config", SETTINGS)
    ints = lambda v: F.array(*[F.lit(i) for i in v])                                # noqa: E731
    window = c["normalization"]
    return chosen.withColumns({
        "tile": F.coalesce(c["tile"], ints(TILE)), "divisor": F.coalesce(c["tile_divisor"], ints(DIVISOR)),
        "overlap": F.coalesce(c["overlap"], F.lit(OVERLAP)), "num_classes": c["num_classes"],
        "lo": F.coalesce(window["clip"][0], F.lit(CLIP[0])), "hi": F.coalesce(window["clip"][1], F.lit(CLIP[1])),
        "mean": F.coalesce(window["mean"], F.lit(MEAN)), "std": F.coalesce(window["std"], F.lit(STD))})


def checksum_audit(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SHA-256 of every file against the expected one: (per file status, per archive verdict).

    ``files``: archive, name, content; ``manifest``: archive, name, expected.
    Missing or differing files fail the whole archive; extra files are ignored.
    """
    actual = files.select("archive", "name", F.sha2("content", 256).alias("actual"))
    both = manifest.join(actual, ["archive", "name"], "full")
    status = (F.when(F.col("expected").isNull(), "extra").when(F.col("actual").isNull(), "missing")
              .when(F.col("expected") != F.col("actual"), "mismatch").otherwise("ok"))
    rows = both.select("archive", "name", status.alias("status"))
    bad = F.col("status").isin("missing", "mismatch")
    verdict = rows.groupBy("archive").agg(
        F.bool_and(~bad).alias("accepted"), F.count(F.when(F.col("status") == "ok", 1)).alias("ok"),
        F.count(F.when(F.col("status") == "missing", 1)).alias("missing"),
        F.count(F.when(F.col("status") == "mismatch", 1)).alias("mismatch"))
    return rows, verdict


def checksum_files(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """Files of a folder as input for ``checksum_audit``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.lit(archive).alias("archive"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")

"""Run reports: nested JSON out, flat rows in."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
EMPTY_SURFACE_BYTES = 100
SLOW_TILE_SECONDS = 1.5

_CLASS = "struct<volume_cm3:double,components:long,triangles:long,stl:string>"
_TOOTH = "struct<fdi:int,name:string,volume_cm3:double,triangles:long,stl:string>"
_ARCH = "struct<crop:array<int>,tile:array<int>,teeth:int,unnumbered_cm3:double,qc:array<string>,skipped:string>"
SCHEMA = (
    "run_id long, input string, grid array<int>, tile array<int>, requested_tile array<int>, "
    "predict_seconds double, device string, "
    f"classes map<string,{_CLASS}>, "
    f"teeth struct<arches:map<string,{_ARCH}>,teeth:map<string,{_TOOTH}>,prosthesis:map<string,{_CLASS}>,seconds:double>, "
    "full_tile_seconds double, full_tile_error string, "
    "model_notice string, seconds double, peak_ram_gb double, crop array<double>")


def class_maps(classes: DataFrame, key: str = "scan_id") -> DataFrame:
    """One ``classes`` map per scan from rows of key, volume_cm3, components, triangles, stl (at most one per class)."""
    entry = F.struct("key", F.struct("volume_cm3", F.col("components").cast("long").alias("components"),
                                     F.col("triangles").cast("long").alias("triangles"), "stl"))
    return classes.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("classes"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object per run; fields without a value are left out."""
    reports.select(F.to_json(F.struct(*reports.columns)).alias("value")).write.mode("overwrite").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports as written, one row per run, under the fixed schema. No inference pass."""
    return spark.read.schema(SCHEMA).json(path)


def report_items(reports: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per run and class, tooth or prosthesis that has a surface.

    ``files`` (run_id, stl, length), if given, adds ``empty``: the file is missing or under 100 bytes.
    ``place`` is upper or lower for teeth (numbers under 30 are upper).
    """
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    def rows(kind: str, column: Column, fdi, name, place) -> DataFrame:
        out = reports.select("run_id", F.explode(column).alias("key", "e"))
        return out.select("run_id", F.lit(kind).alias("kind"), "key", fdi.alias("fdi"), name.alias("name"),
                          place.alias("place"), "e.volume_cm3", "e.triangles", "e.stl")
    fdi = F.coalesce(F.col("e.fdi"), F.col("key").try_cast("int"))
    items = rows("class", F.col("classes"), none_int, none_text, none_text)
    items = items.unionByName(rows("tooth", F.col("teeth.teeth"), fdi, F.coalesce("e.name", F.concat(F.lit("Tooth "), fdi)),
                                   F.when(fdi < 30, "upper").otherwise("lower")))
    items = items.unionByName(rows("prosthesis", F.col("teeth.prosthesis"), none_int, F.initcap(F.translate("key", "_", " ")),
                                   none_text))
    items = items.filter("stl is not null")
    if files is None:
        return items
    sizes = files.groupBy("run_id", "stl").agg(F.max("length").alias("length"))
    return items.join(sizes, ["run_id", "stl"], "left").withColumn(
        "empty", F.coalesce(F.col("length") < EMPTY_SURFACE_BYTES, F.lit(True))).drop("length")


def slow_tile_flag(reports: DataFrame, limit: float = SLOW_TILE_SECONDS) -> DataFrame:
    """Adds ``tile_note``: failed, slow (close to the driver's time limit) or ok."""
    note = (F.when(F.col("full_tile_error").isNotNull(), "failed")
            .when(F.coalesce("full_tile_seconds", F.lit(0.0)) > limit, "slow").otherwise("ok"))
    return reports.withColumn("tile_note", note)


def reduced_tile_flag(reports: DataFrame) -> DataFrame:
    """Adds ``tile_reduced`` (used less than asked for) and ``on_cpu``."""
    return reports.withColumns({
        "tile_reduced": F.col("tile").isNotNull() & F.coalesce(F.col("requested_tile") != F.col("tile"), F.lit(False)),
        "on_cpu": ~F.coalesce(F.col("device"), F.lit("")).contains("GPU")})

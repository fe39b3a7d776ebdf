"""What lies in a folder: files, DICOM series, the input to read."""
from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.plans.attach import salted_join
from voxelspark.plans.ordered import number_rows

# Fixed values.
VOLUME_SUFFIXES = (".dcm", ".mha", ".mhd", ".nrrd", ".nhdr", ".nii", ".nii.gz", ".img", ".hdr", ".vtk",
                   ".gipl", ".mnc", ".mrc", ".rec", ".spr", ".h5", ".tif", ".tiff")
DOUBLE_SUFFIXES = (".nii.gz", ".img.gz", ".gipl.gz")
NO_INPUT = "no DICOM series and no volume file"


def file_kind(path: Column) -> Column:
    """volume, archive or other, by the end of the lower-cased name."""
    low = F.lower(path)
    volume = reduce(lambda a, b: a | b, [low.endswith(s) for s in VOLUME_SUFFIXES])
    return F.when(volume, "volume").when(low.endswith(".zip"), "archive").otherwise("other")


def scan_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below ``folder``: path, length, kind. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", "modificationTime").withColumn("kind", file_kind(F.col("path")))


def series_sizes(slices: DataFrame) -> DataFrame:
    """``root, dir, series_uid, slices``: how many files every series has."""
    return slices.groupBy("root", "dir", "series_uid").agg(F.count(F.lit(1)).alias("slices"))


def _longest(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = sizes.groupBy(*keys).agg(F.min(F.struct((-F.col("slices")).alias("minus"), "dir", "series_uid")).alias("b"))
    return best.select(*keys, "b.dir", "b.series_uid", (-F.col("b.minus")).alias("slices"))


def select_series(slices: DataFrame) -> DataFrame:
    """Per root the series with most files below it (then first dir, then first uid)."""
    return _longest(series_sizes(slices), ["root"])


def resolve_input(manifest: DataFrame, series: DataFrame) -> DataFrame:
    """What to read per root: its series, else the first volume by path, else the only
    top-level archive, else an error. ``manifest``: root, path; ``series``: root, dir."""
    kind = file_kind(F.col("path"))
    top = F.when((kind == "archive") & ~F.col("path").contains("/"), F.col("path"))
    files = manifest.groupBy("root").agg(
        F.min(F.when(kind == "volume", F.col("path"))).alias("volume"),
        F.count(top).alias("archives"), F.min(top).alias("archive"))
    both = files.join(series.select("root", F.col("dir").alias("series_dir")), "root", "full")
    found = (F.when(F.col("series_dir").isNotNull(), F.struct(F.lit("series").alias("how"), F.col("series_dir").alias("path")))
             .when(F.col("volume").isNotNull(), F.struct(F.lit("volume").alias("how"), F.col("volume").alias("path")))
             .when(F.col("archives") == 1, F.struct(F.lit("archive").alias("how"), F.col("archive").alias("path")))
             .otherwise(F.struct(F.lit("error").alias("how"), F.lit(NO_INPUT).alias("path"))))
    return both.select("root", found.alias("f")).select("root", "f.how", "f.path")


def promote_single_slice(volumes: DataFrame, sizes: DataFrame) -> DataFrame:
    """A volume of depth 1 becomes the longest series in its own folder or below it, or an error.

    ``volumes``: volume_id, root, folder ('' is the root itself), depth; ``sizes`` as from
    ``series_sizes``. Adds ``status`` (volume, series, error) and the ``slices`` to read.
    Every series counts for its folder and the folders above: one row per level of its path.
    """
    parts = F.filter(F.split(F.coalesce("dir", F.lit("")), "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    best = _longest(sizes.withColumn("folder", F.explode(above)), ["root", "folder"])
    facts = best.select("root", "folder", F.col("slices").alias("_n"))
    both = salted_join(volumes, facts, ["root", "folder"], "left", salt_by=("volume_id",))
    single = F.col("depth") == 1
    status = F.when(~single, "volume").when(F.coalesce("_n", F.lit(0)) > 1, "series").otherwise("error")
    return both.withColumn("status", status).select(
        *volumes.columns, "status", F.when(F.col("status") == "series", F.col("_n"))
        .when(F.col("status") == "volume", F.col("depth")).alias("slices"))


def drop_time_axis(headers: DataFrame) -> DataFrame:
    """One frame: accepted as three-dimensional; more: refused, with the reason."""
    ok = F.col("frames") == 1
    return headers.withColumns({
        "status": F.when(ok, "ok").otherwise("rejected"),
        "reason": F.when(~ok, F.format_string("a scan with %d time frames is not supported", F.col("frames")))})


def extension(name: Column) -> Column:
    """Suffix with its dot; ``.nii.gz`` and the like as one; empty unless ASCII."""
    low = F.lower(name)
    double = reduce(lambda acc, s: acc.when(low.endswith(s), s), DOUBLE_SUFFIXES[1:],
                    F.when(low.endswith(DOUBLE_SUFFIXES[0]), DOUBLE_SUFFIXES[0]))
    single = F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)
    ext = F.coalesce(double, single)
    return F.when(ext.rlike(r"^[\x00-\x7F]*$"), ext).otherwise("")


def pseudonymise_paths(manifest: DataFrame) -> DataFrame:
    """Neutral names: folders d001.. per parent, files f000001.. per archive, in path order.

    ``manifest``: root (the archive), path. The order within an archive is
    worked out in ranges of paths, and folders are renamed in a table of folders,
    so a huge archive is not one task.
    """
    raw = F.split(F.regexp_replace("path", r"\\", "/"), "/")
    clean = F.filter(F.slice(raw, 1, F.size(raw) - 1), lambda p: ~p.isin("", ".", ".."))
    files = manifest.select("root", "path", clean.alias("parts"), F.element_at(raw, -1).alias("base"))
    files = number_rows(files, ["root"], None, ["path"], "n")

    folders = files.groupBy("root", "parts").agg(F.min("path").alias("first"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", F.lit(1), i))
    prefixes = F.when(F.size("parts") > 0, prefixes)
    steps = folders.select("root", "first", F.explode(prefixes).alias("at"))
    known = steps.groupBy("root", "at").agg(F.min("first").alias("first"))
    known = known.withColumn("parent", F.slice("at", F.lit(1), F.size("at") - 1))
    known = number_rows(known, ["root", "parent"], None, ["first"], "k")
    code = known.select("root", "at", F.format_string("d%03d", F.col("k")).alias("code"))
    named = folders.select("root", "parts", F.explode_outer(prefixes).alias("at"))
    named = named.join(code, ["root", "at"], "left").groupBy("root", "parts").agg(F.concat_ws("/", F.transform(
        F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct(F.size("at").alias("d"), "code")))),
        lambda s: s["code"])).alias("folder"))
    both = salted_join(files, named, ["root", "parts"], salt_by=("path",))
    new = F.concat(F.format_string("f%06d", F.col("n")), extension(F.col("base")))
    return both.select("root", "path", F.when(F.col("folder") == "", new).otherwise(
        F.concat("folder", F.lit("/"), new)).alias("new_path"))

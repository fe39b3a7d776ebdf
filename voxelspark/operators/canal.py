"""Health of the mandibular canal, and repairing it with a second pass."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions import geometry as G
from voxelspark.operators import components as C
from voxelspark.operators.measure import VOXEL, voxel_cm3
from voxelspark.plans.attach import attach
from voxelspark.session import cut_lineage

# Fixed values.
JAW, CANAL = 1, 5
SPECK_CM3 = 0.02
WHOLE_JAW_MM = 75.0
SIDE_SHARE = 0.2
TRIGGERS = {
    "volume_below_cm3": 0.45,
    "side_volume_below_cm3": 0.15,
    "asymmetry_below": 0.45,
    "span_fraction_below": 0.30,
    "components_per_side_above": 2,
}
FINE_SPACING_MM = 0.25
FINE_MARGIN_MM = 15.0


def despecked_canal(labels: DataFrame, scans: DataFrame, block: int = C.BLOCK) -> DataFrame:
    canal = labels.filter(F.col("label") == CANAL)
    return C.drop_small(C.connected_components(canal, by=(), block=block), scans, SPECK_CM3)


def canal_volume(labels: DataFrame, scans: DataFrame, block: int = C.BLOCK) -> DataFrame:
    """Per scan the canal voxels left after dropping specks (from component sizes alone)."""
    canal = labels.filter(F.col("label") == CANAL)
    parts = C.connected_components(canal, by=(), block=block)
    n = C.kept_components(parts, scans, SPECK_CM3).groupBy("scan_id").agg(F.sum("n").alias("n"))
    return scans.select("scan_id").join(n, "scan_id", "left").select("scan_id", F.coalesce("n", F.lit(0)).alias("n"))


def jaw_frame(labels: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per scan: extent, middle and wholeness of the jaw; per scan and side: jaw voxels).

    The jaw is read once, into one row per x column.
    """
    cols = labels.filter(F.col("label") == JAW).groupBy("scan_id", "x").agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cols = cut_lineage(cols)
    jaw = cols.groupBy("scan_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y0").alias("y0"),
                                      F.max("y1").alias("y1"), F.sum("n").alias("jaw_voxels"))
    jaw = jaw.join(scans.select("scan_id", "spacing", "nx"), "scan_id").select(
        "scan_id", "nx", "jaw_voxels", F.floor((F.col("x0") + F.col("x1")) / 2).cast("int").alias("mid"),
        ((F.col("x1") - F.col("x0") + 1) * F.col("spacing")[0] >= WHOLE_JAW_MM).alias("whole_jaw"),
        ((F.col("y1") - F.col("y0") + 1) * F.col("spacing")[1]).alias("jaw_span"))
    jaw = cut_lineage(jaw)
    sides = attach(cols, jaw, salt_by=("x",)).withColumn("side", side_of(F.col("x"))).groupBy(
        "scan_id", "side").agg(F.sum("n").alias("n"))
    return jaw, sides


def side_of(x: Column) -> Column:
    return F.when(F.col("whole_jaw") & (x >= F.col("mid")), 1).otherwise(0)


def canal_health(labels: DataFrame, scans: DataFrame, triggers: Mapping[str, float] = TRIGGERS,
                 block: int = C.BLOCK) -> DataFrame:
    """One row per scan: features of the canal, its sides, and why it looks broken.

    ``sides``: structs (side, vol, span, comps, x0, x1) of the sides that hold
    at least a fifth of the jaw. ``reasons`` is empty for a sound canal.
    """
    t = {**TRIGGERS, **triggers}
    jaw, halves = jaw_frame(labels, scans)
    canal = cut_lineage(despecked_canal(labels, scans, block))
    total = canal.groupBy("scan_id").agg(F.count(F.lit(1)).alias("canal_voxels"))
    split = attach(canal, jaw.select("scan_id", "mid", "whole_jaw")).withColumn("side", side_of(F.col("x")))
    parts = C.connected_components(split.select(*VOXEL, "side"), by=("side",), block=block)
    per = parts.sizes().groupBy("scan_id", "side").agg(
        F.sum("n").alias("voxels"), (F.max("by") - F.min("ay")).alias("length"), F.count(F.lit(1)).alias("comps"))
    cm3 = scans.select("scan_id", voxel_cm3().alias("cm3"), F.col("spacing")[1].alias("sy"))

    held = halves.join(jaw, "scan_id").filter(~F.col("whole_jaw") | (F.col("n") >= SIDE_SHARE * F.col("jaw_voxels")))
    held = held.join(per, ["scan_id", "side"], "left").na.fill(0, ["voxels", "length", "comps"]).join(cm3, "scan_id")
    one = F.struct(
        "side", (F.col("voxels") * F.col("cm3")).alias("vol"), (F.col("length") * F.col("sy")).alias("span"), "comps",
        F.when(F.col("side") == 1, F.col("mid")).otherwise(0).alias("x0"),
        F.when(F.col("whole_jaw") & (F.col("side") == 0), F.col("mid")).otherwise(F.col("nx")).alias("x1"))
    sides = held.groupBy("scan_id").agg(F.sort_array(F.collect_list(one)).alias("sides"))   # at most two

    out = scans.select("scan_id", voxel_cm3().alias("cm3")).join(jaw.drop("nx", "mid"), "scan_id", "left")
    out = out.join(sides, "scan_id", "left").join(total, "scan_id", "left")
    vols, spans = F.transform("sides", lambda s: s["vol"]), F.transform("sides", lambda s: s["span"])
    out = out.withColumns({
        "volume_cm3": F.coalesce("canal_voxels", F.lit(0)) * F.col("cm3"),
        "n_sides": F.coalesce(F.size("sides"), F.lit(0)),
        "vol_min": F.array_min(vols),
        "asym": F.when(F.array_max(vols) > 0, F.array_min(vols) / F.array_max(vols)).otherwise(
            F.when(F.array_max(vols).isNotNull(), F.lit(0.0))),
        "span_frac": F.array_min(spans) / F.col("jaw_span"),
        "comps_max": F.array_max(F.transform("sides", lambda s: s["comps"]))})
    two = F.col("n_sides") == 2
    why = F.array(
        F.when(F.col("jaw_voxels").isNull(), F.lit("no mandible")),
        F.when(two & (F.col("volume_cm3") < t["volume_below_cm3"]), F.format_string("volume %.2f cm3", "volume_cm3")),
        F.when(F.col("vol_min") < t["side_volume_below_cm3"], F.format_string("weak side %.2f cm3", "vol_min")),
        F.when(two & (F.col("asym") < t["asymmetry_below"]), F.format_string("asymmetry %.2f", "asym")),
        F.when(F.col("span_frac") < t["span_fraction_below"], F.format_string("course covered %.2f", "span_frac")),
        F.when(F.col("comps_max") > t["components_per_side_above"],
               F.concat(F.col("comps_max").cast("string"), F.lit(" pieces on one side"))))
    return out.select("scan_id", "volume_cm3", "whole_jaw", "n_sides", "vol_min", "asym", "span_frac", "comps_max",
                      "sides", F.array_compact(why).alias("reasons"))


def sides_to_redo(health: DataFrame, triggers: Mapping[str, float] = TRIGGERS) -> DataFrame:
    """Rows ``scan_id, turn, x0, x1`` to compute again; null x0/x1 means the whole jaw."""
    t = {**TRIGGERS, **triggers}
    bad = F.filter("sides", lambda s: (s["vol"] < t["side_volume_below_cm3"])
                   | (s["comps"] > t["components_per_side_above"]))
    ranges = F.transform(bad, lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("x0"), F.lit(None).cast("int").alias("x1")))
    out = health.select("scan_id", F.posexplode(F.when((F.col("n_sides") == 2) & (F.size(bad) > 0), ranges)
                                                .otherwise(whole)).alias("turn", "r"))
    return out.select("scan_id", "turn", "r.x0", "r.x1")


def fine_box(labels: DataFrame, grid: DataFrame, source: DataFrame, redo: DataFrame,
             margin_mm: float = FINE_MARGIN_MM, spacing: float = FINE_SPACING_MM,
             block: int = C.BLOCK) -> DataFrame:
    """The source box for the second pass: largest jaw piece (within x0..x1) plus a margin.

    Per ``redo`` row: index ranges a*/b* in ``source``, voxels at the fine
    spacing, and ``fits`` (it overlaps the frame).
    """
    parts = C.connected_components(labels.filter(F.col("label") == JAW), by=(), block=block)
    jaw = attach(C.largest_component(parts), redo, sized_by=grid)
    jaw = jaw.filter(F.col("x0").isNull() | ((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))))
    keys = [c for c in ("scan_id", "turn", "x0", "x1") if c in redo.columns]
    box = jaw.groupBy(*keys).agg(*[F.min(a).alias(f"lo_{a}") for a in G.AXES], *[F.max(a).alias(f"hi_{a}") for a in G.AXES])
    box = box.join(grid.select("scan_id", "origin", "spacing", "direction"), "scan_id")
    p = G.to_physical([F.col(f"lo_{a}") for a in G.AXES])
    q = G.to_physical([F.col(f"hi_{a}") for a in G.AXES])
    box = box.select(*keys, F.array(*[F.least(u, v) - margin_mm for u, v in zip(p, q)]).alias("box_lo"),
                     F.array(*[F.greatest(u, v) + margin_mm for u, v in zip(p, q)]).alias("box_hi"))
    out = G.crop_ranges(source.join(box, "scan_id"))
    n = F.lit(1).cast("long")
    for i, a in enumerate(G.AXES):
        n = n * F.rint((F.col(f"b{a}") - F.col(f"a{a}")) * F.col("spacing")[i] / spacing).cast("long")
    return out.select(*keys, *[f"{e}{a}" for e in "ab" for a in G.AXES], n.alias("fine_voxels"),
                      (F.col("status") == "ok").alias("fits"))


def merge_second_pass(labels: DataFrame, canal: DataFrame, scans: DataFrame, covered: DataFrame | None = None,
                      block: int = C.BLOCK) -> DataFrame:
    """Labels with the canal of the second pass, scan by scan unless that finds less.

    ``canal``: voxels of the new canal, taken over background, jaw and old canal
    only. ``covered``: index ranges a*/b* the pass looked at (default: all of
    each scan); the old canal is dropped only there. Where the despecked canal
    would shrink, the scan keeps its first labels.
    """
    old = labels.select(*VOXEL, F.col("label").cast("int").alias("old"), F.lit(None).cast("boolean").alias("new"))
    new = canal.select(*VOXEL, F.lit(None).cast("int").alias("old"), F.lit(True).alias("new"))
    both = old.unionByName(new).groupBy(*VOXEL).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    if covered is None:
        looked = F.lit(True)
    else:
        both = attach(both, covered, sized_by=scans, how="left")
        looked = F.lit(True)
        for a in "zyx":
            looked = looked & (F.col(a) >= F.col(f"a{a}")) & (F.col(a) < F.col(f"b{a}"))
        looked = F.coalesce(looked, F.lit(False))
    take = F.col("new") & (F.col("old").isNull() | F.col("old").isin(JAW, CANAL))
    merged = F.when(take, CANAL).when((F.col("old") == CANAL) & looked, F.lit(None)).otherwise(F.col("old"))
    both = cut_lineage(both.select(*VOXEL, "old", merged.cast("int").alias("merged")))
    before = canal_volume(both.select(*VOXEL, F.col("old").alias("label")), scans, block)
    after = canal_volume(both.select(*VOXEL, F.col("merged").alias("label")), scans, block)
    better = cut_lineage(before.join(after.withColumnRenamed("n", "n2"), "scan_id").select(
        "scan_id", (F.col("n2") >= F.col("n")).alias("better")))
    chosen = attach(both, better).select(*VOXEL, F.when(F.col("better"), F.col("merged")).otherwise(F.col("old"))
                                         .cast("short").alias("label"))
    return chosen.filter("label is not null")

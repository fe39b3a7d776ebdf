"""Numbered instances: arches, assignment, one piece per number, contact-based checks, reports."""
from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelspark.functions import naming
from voxelspark.operators import components as C
from voxelspark.operators.measure import VOXEL, voxel_cm3
from voxelspark.operators.stencil import ASSIGN_MM, DILATE_RADIUS, contacts, dilate, nearest_label
from voxelspark.plans.attach import attach
from voxelspark.session import cut_lineage

# Fixed values.
ARCH_MIN_CM3 = 0.135
ARCH_GAP_MM = 25.0
MIN_TOOTH_CM3 = 0.03
MIN_ARCH_CM3 = 0.5
MERGE_SHARE = 0.25
SPECK_SHARE = 0.10
SMALL_SHARE = 0.35
TYPICAL_CM3 = 0.5

AXES = "zyx"


def is_prosthesis(i: Column) -> Column:
    return i.isin(*naming.PROSTHESES)


def clean_arch_mask(mask: DataFrame, scans: DataFrame, min_cm3: float = ARCH_MIN_CM3,
                    gap_mm: float = ARCH_GAP_MM, block: int = C.BLOCK) -> DataFrame:
    """The arch without false hits far away from it.

    Large pieces always stay (the largest one if none is large). Smaller ones
    join while their box is within ``gap_mm`` of the box of everything taken so far. Works on component boxes; a single-piece
    mask is returned as it is.
    """
    parts = C.connected_components(mask, by=(), block=block)
    facts = scans.select("scan_id", "spacing", voxel_cm3().alias("cm3"))
    ranked = attach(C.ranked_sizes(parts), facts, sized_by=scans, salt_by=("comp",))
    alone = ranked.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("k"),
        F.max((F.col("n") * F.col("cm3") >= min_cm3).cast("int")).alias("any_large"))
    # one row per scan, bounded like the headers themselves
    ranked = attach(ranked, alone, salt_by=("comp",), sized_by=scans)
    keep = (F.col("k") == 1) | F.when(
        F.col("any_large") == 1, F.col("n") * F.col("cm3") >= min_cm3).otherwise(F.col("rank") == 1)
    pieces = cut_lineage(ranked.withColumn("keep", keep))
    while True:
        taken = pieces.filter("keep").groupBy("scan_id").agg(
            *[F.min(f"a{a}").alias(f"lo_{a}") for a in AXES], *[F.max(f"b{a}").alias(f"hi_{a}") for a in AXES])
        both = attach(pieces, taken, salt_by=("comp",), sized_by=scans)
        near = F.lit(True)
        for a, i in zip(AXES, (2, 1, 0)):
            gap = F.greatest(F.lit(0), F.col(f"a{a}") - F.col(f"hi_{a}"), F.col(f"lo_{a}") - F.col(f"b{a}"))
            near = near & (gap <= F.lit(gap_mm) / F.col("spacing")[i])
        grown = cut_lineage(both.withColumn("was", F.col("keep")).withColumn("keep", F.col("keep") | near).select(
            *pieces.columns, "was"))
        done = grown.filter("keep and not was").isEmpty()
        pieces = grown.drop("was")
        if done:
            return parts.join(pieces.filter("keep").select("scan_id", "comp")).drop("comp")


def restrict_ids(pred: DataFrame, mask: DataFrame, scans: DataFrame, own: tuple[int, int],
                 radius: int = DILATE_RADIUS) -> DataFrame:
    """Own-arch numbers, and prostheses only within ``radius`` voxels of the tooth mask."""
    teeth = pred.filter(F.col("id").between(*own))
    extra = pred.filter(is_prosthesis(F.col("id"))).join(dilate(mask, scans, radius), VOXEL, "left_semi")
    return teeth.unionByName(extra)


def assign_numbers(mask: DataFrame, pred: DataFrame, scans: DataFrame, own: tuple[int, int],
                   radius_mm: float = ASSIGN_MM) -> DataFrame:
    """The arch mask with an ``id`` per voxel; voxels that get none are absent.

    Prostheses come from the prediction; other mask voxels take the number of
    the nearest predicted own-arch voxel within ``radius_mm``.
    """
    extra = pred.filter(is_prosthesis(F.col("id"))).select(*VOXEL, F.col("id").cast("int").alias("id"))
    teeth = mask.select(*VOXEL).join(extra, VOXEL, "left_anti")
    near = nearest_label(pred.filter(F.col("id").between(*own)), teeth, scans, radius_mm, "id")
    return extra.unionByName(near.select(*VOXEL, F.col("near").alias("id")))


def unnumbered(mask: DataFrame, numbered: DataFrame, scans: DataFrame) -> DataFrame:
    """Per scan with a mask, the volume of mask voxels that ``assign_numbers`` left out."""
    both = mask.select(*VOXEL).join(numbered.select(*VOXEL, "id"), VOXEL, "left")
    n = both.groupBy("scan_id").agg(F.count(F.when(F.col("id").isNull(), 1)).alias("n"))
    return n.join(scans.select("scan_id", voxel_cm3().alias("cm3")), "scan_id").select(
        "scan_id", (F.col("n") * F.col("cm3")).alias("unnumbered_cm3"))


def one_instance_per_number(teeth: DataFrame, scans: DataFrame, radius_mm: float = ASSIGN_MM,
                            block: int = C.BLOCK) -> DataFrame:
    """One connected piece per natural number: the largest.

    Other pieces take the number of the nearest survivor within ``radius_mm``,
    or vanish. Prostheses keep all their pieces and may be that survivor.
    """
    natural = teeth.filter(~is_prosthesis(F.col("id")))
    parts = C.connected_components(natural, by=("id",), block=block)
    rank = C.ranked_sizes(parts).select("scan_id", "id", "comp", (F.col("rank") == 1).alias("top"))
    marked = cut_lineage(parts.join(rank).select(*VOXEL, "id", "top"))
    kept = marked.filter("top").select(*VOXEL, "id").unionByName(
        teeth.filter(is_prosthesis(F.col("id"))).select(*VOXEL, "id"))
    orphans = marked.filter("not top").select(*VOXEL)
    near = nearest_label(kept, orphans, scans, radius_mm, "id")
    return kept.unionByName(near.select(*VOXEL, F.col("near").cast(kept.schema["id"].dataType).alias("id")))


def _fdi(i: int) -> int:
    return (i - 1) // 8 * 10 + 10 + (i - 1) % 8 + 1


def settle_contacts(count: Mapping[int, int], faces: Mapping[tuple[int, int], int], own: tuple[int, int],
                    cm3: float, typical: Mapping[int, float], merge_share: float = MERGE_SHARE,
                    speck_share: float = SPECK_SHARE) -> tuple[dict[int, int], list[str]]:
    """Merge or drop numbers of one scan, one change per round until nothing changes. At most 35
    numbers take part and each round removes one.

    Returns where every changed number went (0 = dropped) and notes.
    """
    count, faces = dict(count), dict(faces)
    moved, notes = {}, []

    def relabel(old: int, new: int) -> None:
        for (a, b), n in list(faces.items()):
            a2, b2 = (new if a == old else a), (new if b == old else b)
            if (a2, b2) != (a, b):
                del faces[a, b]
                if a2 != b2 and a2 != 0:
                    faces[a2, b2] = faces.get((a2, b2), 0) + n
        count[new] = count.get(new, 0) + count.pop(old)
        count.pop(0, None)
        for k, v in list(moved.items()):
            if v == old:
                moved[k] = new
        moved[old] = new

    while True:
        for t in sorted(count, key=lambda i: (count[i], i)):
            shell = sum(n for (a, _b), n in faces.items() if a == t)
            beside = {b: n for (a, b), n in faces.items() if a == t and own[0] <= b <= own[1]}
            volume, usual = count[t] * cm3, typical.get(_fdi(t) % 10, TYPICAL_CM3)
            if beside:
                mate = min(beside, key=lambda b: (-beside[b], b))
                share = beside[mate] / shell
                if share >= merge_share:
                    stay, go = (mate, t) if count[mate] >= count[t] else (t, mate)
                    notes.append(f"tooth {_fdi(go)} merged into {_fdi(stay)}: {count[go] * cm3:.2f} cm3 "
                                 f"touching it over {share * 100:.0f}% of its surface")
                    relabel(go, stay)
                    break
            elif volume < speck_share * usual:
                notes.append(f"tooth {_fdi(t)} dropped: {volume:.2f} cm3 is {volume / usual * 100:.0f}% "
                             "of a typical one and touches nothing")
                relabel(t, 0)
                break
        else:
            return moved, notes


def qc_merge(numbered: DataFrame, scans: DataFrame, own: tuple[int, int],
             typical: Mapping[int, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two numbers on one tooth are merged, isolated specks dropped: (voxels, ``scan_id, notes``).

    Only the tiny per-scan tables of volumes and contact faces (at most 35
    numbers) reach Python; voxels see a join with the resulting number map.
    """
    typical = dict(typical or {})
    sizes = numbered.filter(F.col("id").between(*own)).groupBy("scan_id", "id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("scan_id").agg(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "n")).alias("sizes"))
    faces = contacts(numbered, scans, "id").groupBy("scan_id").agg(
        F.collect_list(F.struct("a", "b", "faces")).alias("faces"))
    per = sizes.join(faces, "scan_id").join(scans.select("scan_id", voxel_cm3().alias("cm3")), "scan_id")
    result = T.StructType([T.StructField("moves", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("new", T.IntegerType())]))),
        T.StructField("notes", T.ArrayType(T.StringType()))])

    def settle(size: pd.Series, face: pd.Series, cm3: pd.Series) -> pd.DataFrame:
        out = []
        for s, f, v in zip(size, face, cm3):
            moved, notes = settle_contacts({r["id"]: r["n"] for r in s},
                                           {(r["a"], r["b"]): r["faces"] for r in f}, own, v, typical)
            out.append(([{"id": k, "new": n} for k, n in moved.items()], notes))
        return pd.DataFrame(out, columns=["moves", "notes"])

    settled = cut_lineage(per.select("scan_id", F.pandas_udf(settle, result)("sizes", "faces", "cm3").alias("r")))
    moves = settled.select("scan_id", F.explode("r.moves").alias("m")).select("scan_id", "m.id", "m.new")
    both = attach(numbered.withColumn("id", F.col("id").cast("int")), moves, on=["scan_id", "id"], how="left")
    voxels = both.withColumn("id", F.coalesce("new", "id")).filter("id > 0").select(*VOXEL, "id")
    return voxels, settled.select("scan_id", F.col("r.notes").alias("notes"))


def small_tooth_notes(numbered: DataFrame, scans: DataFrame, own: tuple[int, int],
                      typical: Mapping[int, float] | None = None, share: float = SMALL_SHARE) -> DataFrame:
    """One note per tooth well under the typical volume of its type."""
    usual = F.lit(TYPICAL_CM3)
    for kind, v in (typical or {}).items():
        usual = F.when(naming.fdi_number(F.col("id")) % 10 == kind, F.lit(float(v))).otherwise(usual)
    sizes = numbered.filter(F.col("id").between(*own)).groupBy("scan_id", "id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(scans.select("scan_id", voxel_cm3().alias("cm3")), "scan_id").withColumns(
        {"volume": F.col("n") * F.col("cm3"), "usual": usual})
    small = sizes.filter(F.col("volume") < share * F.col("usual"))
    note = F.format_string("tooth %d is small: %.2f cm3, %.0f%% of typical", naming.fdi_number(F.col("id")),
                           F.col("volume"), F.col("volume") / F.col("usual") * 100)
    return small.select("scan_id", "id", note.alias("note"))


def merge_arches(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """One number per voxel; the upper arch wins where both assign one."""
    both = upper.select(*VOXEL, F.struct(F.lit(0).alias("turn"), F.col("id").cast("int").alias("id")).alias("c")).unionByName(
        lower.select(*VOXEL, F.struct(F.lit(1).alias("turn"), F.col("id").cast("int").alias("id")).alias("c")))
    return both.groupBy(*VOXEL).agg(F.min("c").alias("c")).select(*VOXEL, F.col("c.id").alias("id"))


def arches_present(labels: DataFrame, scans: DataFrame, min_cm3: float = MIN_ARCH_CM3) -> DataFrame:
    """Per scan and tooth class (3 upper, 4 lower): volume and whether it is worth numbering."""
    n = labels.filter("label in (3, 4)").groupBy("scan_id", F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    frame = scans.select("scan_id", voxel_cm3().alias("cm3"), F.explode(F.array(F.lit(3), F.lit(4))).alias("label"))
    both = frame.join(n, ["scan_id", "label"], "left")
    volume = F.coalesce("n", F.lit(0)) * F.col("cm3")
    return both.select("scan_id", "label", F.when(F.col("label") == 3, "upper").otherwise("lower").alias("arch"),
                       volume.alias("volume_cm3"), (volume >= min_cm3).alias("used"))


def tooth_report(numbered: DataFrame, scans: DataFrame, min_cm3: float = MIN_TOOTH_CM3,
                 block: int = C.BLOCK) -> DataFrame:
    """One row per tooth (number, name, volume) and prosthesis (volume, components)."""
    parts = C.connected_components(numbered, by=("id",), block=block)
    kept = C.kept_components(parts, scans, min_cm3).groupBy("scan_id", "id", "_cm3").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("components"))
    i = F.col("id")
    other = F.element_at(F.create_map(*[F.lit(v) for kv in naming.PROSTHESES.items() for v in kv]), i.cast("int"))
    tooth = ~is_prosthesis(i)
    return kept.select(
        "scan_id", F.when(tooth, naming.fdi_number(i).cast("string")).otherwise(other).alias("key"),
        F.when(tooth, naming.fdi_number(i)).alias("fdi"), F.when(tooth, naming.tooth_name(i)).otherwise(other).alias("name"),
        F.bround(F.col("n") * F.col("_cm3"), 2).alias("volume_cm3"),
        F.when(~tooth, F.col("components")).alias("components"))

"""Whole flows: several operators in the order a user runs them."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions import geometry as G
from voxelspark.functions import intensity as I
from voxelspark.functions import naming, tiling
from voxelspark.operators import canal as K
from voxelspark.operators import components as C
from voxelspark.operators import blocks, crop, halo, histogram, instances, matching, measure, regions, resample
from voxelspark.plans.attach import attach
from voxelspark.session import cut_lineage
from voxelspark.sources import config

Scorer = Callable[[np.ndarray], np.ndarray]


def class_volumes_of_valid_scans(voxels: DataFrame, scans: DataFrame) -> DataFrame:
    """Refuse insane headers, normalise, threshold into two classes, and measure them."""
    ok = scans.filter(G.spacing_is_sane())
    v = I.normalize_ct(F.col("hu"))
    kept = attach(voxels, ok.select("scan_id"), sized_by=scans)
    labels = kept.select("scan_id", F.when(v > 0.5, 1).when(v > -0.8, 2).alias("label")).filter("label is not null")
    return measure.class_volumes(labels, ok)


def score_volumes(voxels: DataFrame, scans: DataFrame, score: Scorer, tile: Sequence[int] | None, num_classes: int,
                  overlap: float | None = 0.5, block: int = blocks.BLOCK) -> DataFrame:
    """Pack into blocks, cut, score and blend every scan: blocks of logits. Without ``tile``, scans have their own."""
    return blocks.score_blocks(blocks.to_blocks(voxels, scans, block), scans, score, tile, num_classes, overlap, block)


def label_volumes(voxels: DataFrame, scans: DataFrame, score: Scorer, tile: Sequence[int] | None, num_classes: int,
                  overlap: float | None = 0.5, block: int = blocks.BLOCK) -> DataFrame:
    """The class of every voxel, background left out: rows again, as what follows works on sparse labels."""
    logits = score_volumes(voxels, scans, score, tile, num_classes, overlap, block)
    return blocks.voxels_of(blocks.argmax_blocks(logits, num_classes), "label").filter("label > 0")


def label_configured(voxels: DataFrame, scans: DataFrame, chosen: DataFrame, score: Scorer, num_classes: int,
                     block: int = blocks.BLOCK) -> tuple[DataFrame, DataFrame]:
    """Labels as each scan's configuration row says: its window, tile, divisor and overlap, all scans in one job.

    ``chosen``: scan_id and ``config`` (``load_config``). Scans without one are left out and named. Returns
    (labels without background, scans with their fitted tiles or an ``error``).
    """
    own = config.settings(chosen.select("scan_id", "config", "error"))
    fitted = tiling.fit_tile(scans.join(own, "scan_id", "left"), F.col("tile"), F.col("divisor"))
    fitted = cut_lineage(fitted.withColumn("error", F.coalesce("error", F.when(F.col("config").isNull(), config.NOT_FOUND))))
    ready = fitted.filter("error IS NULL")
    rows = attach(voxels, ready.select("scan_id", "lo", "hi", "mean", "std"), sized_by=scans)
    window = I.normalize_ct(F.col("hu"), F.col("lo"), F.col("hi"), F.col("mean"), F.col("std"))
    rows = rows.select("scan_id", "z", "y", "x", window.cast("float").alias("hu"))
    return label_volumes(rows, ready, score, None, num_classes, None, block), fitted


def segment_blocks(voxels: DataFrame, scans: DataFrame, score: Scorer, tile: Sequence[int], num_classes: int,
                   spacing: float = G.GRID_SPACING_MM, overlap: float = 0.5, block: int = blocks.BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orient, resample, normalise, score and take the arg-max of every sane scan.

    Returns (blocks of logits, blocks of labels with background, headers of the grid). Labels are written. With tiles
    well below a block neither the resampled voxels nor their scores are shuffled or written, and logits are scored
    again when read; with larger ones they are written and labels follow from them.
    """
    ok = scans.filter(G.spacing_is_sane())
    turned = crop.orient_lps(attach(voxels, ok.select("scan_id"), sized_by=scans), ok)
    heads = G.orient_lps_headers(ok)
    grid = resample.resampled_headers(heads, spacing)
    if regions.suits(tile, overlap, block):
        source = blocks.to_blocks(turned, heads, block)
        logits, labels = (regions.resampled_scores(source, heads, grid, I.normalized, score, tile, num_classes, spacing, overlap, block, own)
                          for own in (False, True))
        return logits, cut_lineage(labels, arrays=True), grid
    fine = resample.resample_linear(turned, heads, spacing)
    ready = fine.withColumn("hu", I.normalize_ct(F.col("hu")).cast("float"))
    logits = cut_lineage(score_volumes(ready, grid, score, tile, num_classes, overlap, block), arrays=True)
    return logits, cut_lineage(blocks.argmax_blocks(logits, num_classes), arrays=True), grid


def segment(voxels: DataFrame, scans: DataFrame, score: Scorer, tile: Sequence[int], num_classes: int,
            spacing: float = G.GRID_SPACING_MM, overlap: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``segment_blocks`` with labels as rows, without background."""
    logits, labels, grid = segment_blocks(voxels, scans, score, tile, num_classes, spacing, overlap)
    return logits, blocks.voxels_of(labels, "label").filter("label > 0"), grid


def class_report(labels: DataFrame, scans: DataFrame, block: int = C.BLOCK) -> DataFrame:
    """Per scan and class: volume after dropping specks, components and specks dropped.

    ``labels``: rows, or blocks of edge ``block``, whose voxels are then never rows."""
    parts = C.components_of_blocks(labels, block) if "shape" in labels.columns else C.connected_components(labels, block=block)
    n = C.count_components(parts, scans).withColumnRenamed("label", "class_id")
    frame = scans.select("scan_id", measure.voxel_cm3().alias("cm3"), F.explode(naming.class_table()).alias("c"))
    both = frame.select("scan_id", "cm3", F.col("c.id").alias("class_id"), "c.key").join(
        n.withColumn("class_id", F.col("class_id").cast("int")), ["scan_id", "class_id"], "left")
    both = both.na.fill(0, ["raw", "components", "voxels", "specks"])
    return both.select("scan_id", "class_id", "key", F.bround(F.col("voxels") * F.col("cm3"), 2).alias("volume_cm3"),
                       "components", "specks")


def preview_grid(voxels: DataFrame, scans: DataFrame, spacing: float = resample.PREVIEW_SPACING_MM,
                 sigma_mm: float = resample.PREVIEW_SIGMA_MM, block: int = blocks.BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks of the smoothed coarse grid and its thresholds, ready for ``sources.preview``."""
    source = blocks.to_blocks(voxels, scans, block)
    coarse = cut_lineage(regions.resampled_blocks(source, scans, spacing, block, smooth=halo.gaussian(sigma_mm)), arrays=True)
    return coarse, histogram.otsu_thresholds(histogram.inside_fov(blocks.voxels_of(coarse, "hu")))


def evaluate(truth: DataFrame, ours: DataFrame, other: DataFrame) -> DataFrame:
    return measure.dice_summary(measure.dice(truth, ours, other))


def second_pass_match(voxels: DataFrame, labels: DataFrame, scans: DataFrame, score: Scorer, tile: Sequence[int],
                      num_classes: int, fractions: Sequence[float], reference: Sequence[float],
                      margin: int = matching.MARGIN_VOXELS) -> DataFrame:
    """Canal voxels found again after matching the jaw's surroundings to the reference curve."""
    jaw = labels.filter(F.col("label") == K.JAW)
    box = measure.bounding_box(jaw, scans, by=["scan_id"], margin=margin).drop("voxels")
    box = cut_lineage(box.join(scans.select("scan_id", "spacing", "origin", "direction"), "scan_id"))
    lo, hi = I.CLIP                            # metal must not move the top knots
    near = crop.recentred(voxels, box).withColumn("hu", F.least(F.greatest(F.col("hu").cast("double"), F.lit(lo)), F.lit(hi)))
    matched = matching.match_quantiles(near, fractions, reference)
    ready = matched.select("scan_id", "z", "y", "x", I.normalize_ct(F.col("matched")).cast("float").alias("hu"))
    found = label_volumes(ready, crop.cropped_headers(box), score, tile, num_classes).filter(F.col("label") == K.CANAL)
    back = attach(found, box.select("scan_id", *[f"a{a}" for a in G.AXES]))
    return back.select("scan_id", *[(F.col(a) + F.col(f"a{a}")).cast("int").alias(a) for a in "zyx"])


def second_pass_fine(source: DataFrame, source_scans: DataFrame, labels: DataFrame, grid: DataFrame,
                     redo: DataFrame, score: Scorer, tile: Sequence[int], num_classes: int,
                     spacing: float = K.FINE_SPACING_MM, margin_mm: float = K.FINE_MARGIN_MM,
                     block: int = C.BLOCK) -> tuple[DataFrame, DataFrame]:
    """The jaw predicted again on a finer grid: (canal voxels on ``grid``, covered ranges).

    ``redo`` holds at most one row per scan; only its x range may change. The
    source may have any direction: it is turned like the grid first.
    """
    turned = G.orient_lps_headers(source_scans).drop("axis", "flip")
    source, source_scans = crop.orient_lps(source, source_scans), cut_lineage(turned)
    box = K.fine_box(labels, grid, source_scans, redo, margin_mm, spacing, block).filter("fits")
    box = cut_lineage(box.join(source_scans.select("scan_id", "spacing", "origin", "direction"), "scan_id"))
    heads = crop.cropped_headers(box)
    fine_heads = resample.resampled_headers(heads, spacing)
    fine = resample.resample_linear(crop.recentred(source, box), heads, spacing)
    ready = fine.withColumn("hu", I.normalize_ct(F.col("hu")).cast("float"))
    found = label_volumes(ready, fine_heads, score, tile, num_classes).filter(F.col("label") == K.CANAL)
    half = box.select("scan_id", F.coalesce("x0", F.lit(0)).alias("half_lo"),
                      F.coalesce("x1", F.lit(1 << 30)).alias("half_hi"))
    d = F.col("direction")                     # both grids share it: origins differ by a shift along the axes
    shift = [sum(d[3 * r + i] * (F.col("origin")[r] - F.col("o")[r]) for r in range(3)) for i in range(3)]
    sub = fine_heads.join(grid.select("scan_id", F.col("origin").alias("o")), "scan_id").select(
        "scan_id", *[F.col(f"n{a}").alias(f"sub_n{a}") for a in G.AXES],
        F.col("spacing").alias("sub_spacing"), F.array(*shift).alias("sub_origin")).join(half, "scan_id")
    covered = crop.coverage_ranges(grid.withColumn("origin", F.array(*[F.lit(0.0)] * 3)), sub, x_range=True)
    on_grid = resample.resample_nearest(found, fine_heads, grid)
    covered = cut_lineage(covered)
    return crop.within(on_grid, covered).select(*measure.VOXEL), covered


def refine_canal(labels: DataFrame, grid: DataFrame, score: Scorer, tile: Sequence[int], num_classes: int,
                 mode: str = "fine", force: bool = False, triggers: Mapping[str, float] = K.TRIGGERS,
                 source: tuple[DataFrame, DataFrame] | None = None, voxels: DataFrame | None = None,
                 curve: tuple[Sequence[float], Sequence[float]] | None = None,
                 spacing: float = K.FINE_SPACING_MM, margin_mm: float = K.FINE_MARGIN_MM,
                 margin: int = matching.MARGIN_VOXELS, block: int = C.BLOCK) -> DataFrame:
    """Labels with a repaired canal, where the first pass left it broken.

    Only scans with reasons (or all with a jaw, if forced) are computed again.
    ``fine`` needs ``source`` = (voxels, headers) and redoes broken sides one
    after the other; ``match`` needs ``voxels`` on the grid and ``curve`` =
    (fractions, values). A scan whose canal would shrink keeps its first one.
    """
    if mode not in ("fine", "match"):
        raise ValueError(f"unknown mode: {mode!r}")
    health = cut_lineage(K.canal_health(labels, grid, triggers, block))
    asked = health.filter(F.col("whole_jaw").isNotNull() & (F.lit(force) | (F.size("reasons") > 0)))
    if asked.isEmpty():
        return labels
    if mode == "match":
        ids = asked.select("scan_id")
        part, frame = attach(labels, ids, sized_by=grid), grid.join(ids, "scan_id")
        found = second_pass_match(attach(voxels, ids, sized_by=grid), part, frame, score, tile, num_classes,
                                  curve[0], curve[1], margin)
        merged = K.merge_second_pass(part, found, frame, block=block)
        return _replace(labels, merged, ids, grid)
    whole = F.lit(None).cast("int")
    redo = (asked.select("scan_id", F.lit(0).alias("turn"), whole.alias("x0"), whole.alias("x1")) if force
            else K.sides_to_redo(asked, triggers))
    redo = cut_lineage(redo)
    for turn in (0, 1):                        # a jaw has two sides
        now = redo.filter(F.col("turn") == turn)
        ids = now.select("scan_id")
        if ids.isEmpty():
            break
        part, frame = attach(labels, ids, sized_by=grid), grid.join(ids, "scan_id")
        found, covered = second_pass_fine(attach(source[0], ids, sized_by=grid), source[1].join(ids, "scan_id"), part,
                                          frame, now, score, tile, num_classes, spacing, margin_mm, block=block)
        labels = cut_lineage(_replace(labels, K.merge_second_pass(part, found, frame, covered, block), ids, grid))
    return labels


def _replace(labels: DataFrame, new: DataFrame, ids: DataFrame, grid: DataFrame) -> DataFrame:
    rest = attach(labels, ids.withColumn("_new", F.lit(True)), sized_by=grid, how="left").filter("_new is null")
    return rest.select(*labels.columns).unionByName(new.select(*labels.columns))


def separate_teeth(voxels: DataFrame, labels: DataFrame, scans: DataFrame, score: Scorer, tile: Sequence[int],
                   num_classes: int = 36, margin_mm: float = 5.0, typical: Mapping[int, float] | None = None,
                   radius_mm: float = instances.ASSIGN_MM, block: int = C.BLOCK,
                   window: Mapping[str, float] | None = None, own_ids: Mapping[str, tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered teeth of both arches: (voxels with ``id``, one report row per scan and arch).

    ``window`` (lo, hi, mean, std) and ``own_ids`` (upper, lower) are the tooth scorer's own,
    as its configuration row has them; by default those of the class scorer and of naming.
    """
    window, own_ids = dict(window or {}), {"upper": naming.UPPER_IDS, "lower": naming.LOWER_IDS} | dict(own_ids or {})
    present = cut_lineage(instances.arches_present(labels, scans))
    done, reports = [], []
    for arch, label, own in (("upper", 3, own_ids["upper"]), ("lower", 4, own_ids["lower"])):
        ids = present.filter((F.col("arch") == arch) & F.col("used")).select("scan_id")
        frame = cut_lineage(scans.join(ids, "scan_id"))
        mask = attach(labels.filter(F.col("label") == label), ids, sized_by=scans).select(*measure.VOXEL)
        clean = instances.clean_arch_mask(mask, frame, block=block)
        box = measure.bounding_box(clean, None, by=["scan_id"]).drop("voxels").join(frame, "scan_id")
        wide = F.rint(F.lit(margin_mm) / F.col("spacing")[0]).cast("int")
        for a in G.AXES:
            box = box.withColumns({f"a{a}": F.greatest(F.col(f"a{a}") - wide, F.lit(0)),
                                   f"b{a}": F.least(F.col(f"b{a}") + wide, F.col(f"n{a}"))})
        box = cut_lineage(box)
        ready = crop.recentred(voxels, box).withColumn("hu", I.normalize_ct(F.col("hu"), **window).cast("float"))
        heads = cut_lineage(crop.cropped_headers(box))
        pred = label_volumes(ready, heads, score, tile, num_classes)
        pred = cut_lineage(pred.withColumnRenamed("label", "id"))    # score once
        inside = crop.recentred(mask, box)
        pred = cut_lineage(instances.restrict_ids(pred, inside, heads, own))
        numbered = cut_lineage(instances.assign_numbers(inside, pred, heads, own, radius_mm))
        lost = instances.unnumbered(inside, numbered, heads)
        single = instances.one_instance_per_number(numbered, heads, radius_mm, block)
        settled, notes = instances.qc_merge(cut_lineage(single), heads, own, typical)
        back = attach(settled, box.select("scan_id", *[f"a{a}" for a in G.AXES]))
        back = cut_lineage(back.select("scan_id", *[(F.col(a) + F.col(f"a{a}")).cast("int").alias(a) for a in "zyx"], "id"))
        done.append(back)
        count = back.filter(F.col("id").between(*own)).groupBy("scan_id").agg(F.countDistinct("id").alias("teeth"))
        report = present.filter(F.col("arch") == arch).join(lost, "scan_id", "left").join(
            notes, "scan_id", "left").join(count, "scan_id", "left")
        reports.append(report.select("scan_id", "arch", F.col("used"), F.coalesce("teeth", F.lit(0)).alias("teeth"),
                                     F.bround("unnumbered_cm3", 2).alias("unnumbered_cm3"), "notes"))
    return instances.merge_arches(*done), reports[0].unionByName(reports[1])

"""Headline operators at one scale, as one JSON line.

Scans, voxels and labels are derived from the test tables; the derived tables
are written once before timing, so that the operators are measured, not the
formulas. ``queries`` holds seconds, ``rows_per_sec`` input rows per second.
"""
import json
import os
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from suites.fixtures import Fixtures
from suites.tilings import linear_scorer
from voxelspark import cut_lineage, tune
from voxelspark.operators import blocks, canal, components, halo, histogram, matching, measure, quantiles, resample, stencil
from voxelspark.operators import surface
from voxelspark.plans import flows


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", shared).config("spark.local.dir", shared).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    fx = Fixtures(tune(spark), sf_dir)
    scans, qc = cut_lineage(fx.scans), cut_lineage(fx.qc_scans)
    voxels, labels = cut_lineage(fx.voxels), cut_lineage(fx.labels)
    ours, other, truth = cut_lineage(fx.ours), cut_lineage(fx.other), cut_lineage(fx.truth)
    n_vox, n_lab = voxels.count(), labels.count()
    curve = ([i / 32 for i in range(33)], [-1000.0 + 60.0 * i for i in range(33)])

    cubes = cut_lineage(blocks.to_blocks(voxels, scans, 16))
    logit_cubes = cut_lineage(blocks.score_blocks(cubes, scans, linear_scorer, (16, 16, 16), 10, block=16))
    same = lambda _, box: np.moveaxis(box, -1, 0)                                              # noqa: E731

    def blended():
        pieces = blocks.tile_pieces(logit_cubes, scans, (16, 16, 16), value="logit", channels=10)
        return blocks.blend_tiles(blocks.map_tiles(pieces, same, 16, 10), 10, 16)

    todo = {
        "class_volumes": (n_vox, lambda: flows.class_volumes_of_valid_scans(voxels, scans)),
        "resample_linear": (n_vox, lambda: resample.resample_linear(voxels, scans)),
        "resample_nearest": (n_lab, lambda: resample.resample_nearest(labels, scans, scans)),
        "intensity_percentiles": (n_vox, lambda: quantiles.intensity_percentiles(voxels, [0.0, 0.25, 0.5, 0.75, 0.995, 1.0])),
        "otsu_thresholds": (n_vox, lambda: histogram.otsu_thresholds(voxels)),
        "match_quantiles": (n_vox, lambda: matching.match_quantiles(voxels, *curve)),
        "contacts": (n_lab, lambda: stencil.contacts(labels, scans)),
        "dilate": (n_lab, lambda: stencil.dilate(labels.filter("label = 3"), scans)),
        "iso_vertices": (n_vox, lambda: surface.iso_vertices(voxels, scans, 400.0)),
        "to_blocks": (n_vox, lambda: blocks.to_blocks(voxels, scans, 16)),
        "blend_tiles": (n_vox, blended),
        "score_tiles": (n_vox, lambda: blocks.score_blocks(cubes, scans, linear_scorer, (16, 16, 16), 10, block=16)),
        "gaussian_smooth": (n_vox, lambda: halo.gaussian_blocks(cubes, scans, block=16)),
        "argmax_label": (n_vox, lambda: blocks.argmax_blocks(logit_cubes, 10)),
        "dice": (3 * n_lab, lambda: measure.dice(truth, ours, other)),
        "connected_components": (n_lab, lambda: components.connected_components(labels).sizes()),
        "canal_health": (n_lab, lambda: canal.canal_health(labels, qc)),
    }
    seconds, rate = {}, {}
    for name, (rows, build) in todo.items():
        best = None
        for _ in range(2):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            spent = time.time() - start
            best = spent if best is None else min(best, spent)
        seconds[name], rate[name] = round(best, 3), round(rows / best)
    print(json.dumps({"metric": "headline operators, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "rows_per_sec": rate, "voxels": n_vox, "labels": n_lab,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

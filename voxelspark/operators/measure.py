"""Volumes, boxes and agreement between label maps."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions import geometry as G
from voxelspark.functions import naming
from voxelspark.operators.quantiles import quantiles

VOXEL = ["scan_id", "z", "y", "x"]


def voxel_cm3(spacing="spacing") -> Column:
    s = F.col(spacing) if isinstance(spacing, str) else spacing
    return s[0] * s[1] * s[2] / 1000.0


def class_volumes(labels: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per scan and class: voxels and volume (2 decimals), zero when absent."""
    counted = labels.groupBy("scan_id", F.col("label").cast("int").alias("class_id")).agg(
        F.count(F.lit(1)).alias("n"))
    frame = scans.select("scan_id", "spacing", F.explode(naming.class_table()).alias("c"))
    frame = frame.select("scan_id", "spacing", F.col("c.id").alias("class_id"), "c.key", "c.name")
    both = frame.join(counted, ["scan_id", "class_id"], "left")
    n = F.coalesce("n", F.lit(0))
    return both.select("scan_id", "class_id", "key", "name", n.alias("voxels"),
                       F.bround(n * voxel_cm3(), 2).alias("volume_cm3"))


def bounding_box(labels: DataFrame, scans: DataFrame | None = None,
                 by: Sequence[str] = ("scan_id", "label"), margin: int = 0) -> DataFrame:
    """Half-open index ranges a*/b* per group, widened by ``margin`` voxels within the frame."""
    box = labels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("voxels"),
        *[F.min(a).alias(f"a{a}") for a in "zyx"], *[(F.max(a) + 1).alias(f"b{a}") for a in "zyx"])
    if scans is None:
        return box
    box = box.join(scans.select("scan_id", *G.SIZE), "scan_id")
    for a in "zyx":
        box = box.withColumns({f"a{a}": F.greatest(F.col(f"a{a}") - margin, F.lit(0)),
                               f"b{a}": F.least(F.col(f"b{a}") + margin, F.col(f"n{a}"))})
    return box.drop(*G.SIZE)


def side_by_side(label: str = "label", **maps: DataFrame) -> DataFrame:
    """Several sparse label maps in one row per voxel (null = background there).

    One shuffle with partial aggregation instead of a chain of outer joins.
    """
    parts = []
    for name, df in maps.items():
        parts.append(df.select(*VOXEL, *[(F.col(label).cast("int") if n == name
                                          else F.lit(None).cast("int")).alias(n) for n in maps]))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*VOXEL).agg(*[F.max(n).alias(n) for n in maps])


def _dice(both: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(float("nan"))).otherwise(2.0 * both / (a + b))


def dice(truth: DataFrame, ours: DataFrame, other: DataFrame) -> DataFrame:
    """Overlap per scan and class: ours and other against the truth, and with each other.

    Classes absent from both truth and ours are skipped; the two against the
    truth are null where the truth has none of the class (an empty prediction
    of a present class scores 0).
    """
    rows = side_by_side(truth=truth, ours=ours, other=other)
    names = ("truth", "ours", "other")
    rows = rows.withColumn("class_id", F.explode(F.array_distinct(F.array_compact(
        F.array(*names)))))
    is_ = {n: F.coalesce(F.col(n) == F.col("class_id"), F.lit(False)) for n in names}
    count = lambda c, n: F.sum(c.cast("long")).alias(n)                        # noqa: E731
    n = rows.groupBy("scan_id", "class_id").agg(
        *[count(is_[k], f"n_{k}") for k in names],
        count(is_["truth"] & is_["ours"], "t_ours"), count(is_["truth"] & is_["other"], "t_other"),
        count(is_["ours"] & is_["other"], "o_other"))
    n = n.filter((F.col("n_truth") > 0) | (F.col("n_ours") > 0))
    seen = F.col("n_truth") > 0
    return n.select(
        "scan_id", "class_id",
        F.when(seen, _dice(F.col("t_ours"), F.col("n_truth"), F.col("n_ours"))).alias("ours"),
        F.when(seen, _dice(F.col("t_other"), F.col("n_truth"), F.col("n_other"))).alias("other"),
        _dice(F.col("o_other"), F.col("n_ours"), F.col("n_other")).alias("agreement"))


def dice_summary(scores: DataFrame) -> DataFrame:
    """Means per class (4 decimals) and, as ``class_id`` 0, the mean of the class means."""
    per = scores.groupBy("class_id").agg(
        F.count("ours").alias("n"), *[F.bround(F.avg(c), 4).alias(c) for c in ("ours", "other", "agreement")])
    per = per.filter(F.col("n") > 0)
    total = per.filter(~F.isnan("ours")).agg(
        F.lit(0).alias("class_id"), F.sum("n").alias("n"),
        *[F.bround(F.avg(c), 4).alias(c) for c in ("ours", "other", "agreement")])
    return per.unionByName(total).withColumn("difference", F.bround(F.col("ours") - F.col("other"), 4))


def voxel_agreement(a: DataFrame, b: DataFrame, scans: DataFrame) -> DataFrame:
    """Share of all voxels of the frame that carry the same label, background included."""
    rows = side_by_side(a=a, b=b)
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("long")
    n = rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("seen"), F.sum(same).alias("same"))
    total = F.col("nx").cast("long") * F.col("ny") * F.col("nz")
    both = scans.join(n, "scan_id", "left").na.fill(0, ["seen", "same"])
    equal = total - F.col("seen") + F.col("same")
    return both.select("scan_id", equal.alias("equal"), total.alias("total"), (equal / total).alias("share"))


def calibrate_triggers(features: DataFrame, trip_share: float = 0.03) -> DataFrame:
    """Threshold per feature that at most ``trip_share`` of the healthy cases cross.

    ``features``: feature, value, low_is_bad. Returns feature and threshold.
    """
    out = quantiles(features, ["feature", "low_is_bad"], "value", [trip_share, 1 - trip_share])
    return out.filter(F.col("low_is_bad") == (F.col("level") == 0)).select(
        "feature", "low_is_bad", F.col("value").alias("threshold"))


def typical_volumes(teeth: DataFrame, scans: DataFrame) -> DataFrame:
    """Median volume in cm3 per tooth type (the last digit of the number)."""
    per = teeth.filter(F.col("id").between(1, 32)).groupBy("scan_id", "id").agg(F.count(F.lit(1)).alias("n"))
    per = per.join(scans.select("scan_id", "spacing"), "scan_id").select(
        (naming.fdi_number(F.col("id")) % 10).alias("tooth_type"), (F.col("n") * voxel_cm3()).alias("volume"))
    return quantiles(per, ["tooth_type"], "volume", [0.5]).select(
        "tooth_type", F.col("value").alias("median_cm3"))


def stratified_sample(scans: DataFrame, prefix: Column, per_prefix: int = 10, order: Column | None = None,
                      seed: int = 31) -> DataFrame:
    """Up to ``per_prefix`` scans of each source, in a fixed pseudo-random order.

    The rank filter lets every partition drop rows beyond ``per_prefix`` before
    the shuffle, so a dominant source costs no more than a small one.
    """
    from pyspark.sql.window import Window as W
    key = F.xxhash64(F.lit(seed), F.col("scan_id")) if order is None else order
    w = W.partitionBy("prefix").orderBy(key, "scan_id")
    ranked = scans.withColumn("prefix", prefix).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= per_prefix)


def tooth_number_accuracy(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Per scan: teeth, correctly numbered, wrongly numbered, missed and extra.

    A true tooth takes the number of the predicted tooth it overlaps most
    (lowest number on ties); a predicted tooth overlapping no true one is extra.
    """
    rows = side_by_side("id", truth=truth.filter("id between 1 and 32"), pred=pred.filter("id between 1 and 32"))
    n = rows.groupBy("scan_id", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("pred").isNotNull(), F.struct(F.col("n"), -F.col("pred")))
    best = n.filter("truth is not null").groupBy("scan_id", "truth").agg(F.max(hit).alias("best"))
    number = -F.col("best")["col2"]
    per = best.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("teeth"),
        F.sum((number == F.col("truth")).cast("int")).alias("correct"),
        F.sum((number != F.col("truth")).cast("int")).alias("wrong"),
        F.sum(F.col("best").isNull().cast("int")).alias("missed"))
    alone = n.filter("pred is not null").groupBy("scan_id", "pred").agg(
        F.max(F.col("truth").isNotNull()).alias("met"))
    extra = alone.groupBy("scan_id").agg(F.sum((~F.col("met")).cast("int")).alias("extra"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)             # noqa: E731
    return per.join(extra, "scan_id", "full").select(
        "scan_id", *[zero(c) for c in ("teeth", "correct", "wrong", "missed", "extra")])

"""Exact quantiles: keys of few values are sorted whole, the others selected in two passes.

Keys are counted first. The values of a key that has at most ``FEW`` become one sorted array (each
task packs what it has before the shuffle): nearly every one would be a bin of its own. For larger keys
a histogram is followed by ranks inside the bins that hold a wanted one: no value is written or
shuffled for itself but those of the wanted bins, counted. The histogram is combined in every
task; a bin that holds most of all values is ranked in range buckets like any other, so no large
group is gathered in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.plans.attach import attach
from voxelspark.plans.ordered import running_sum
from voxelspark.session import cut_lineage

BINS = 4096                     # a multiple of 64
FEW = 1 << 14                   # values of a key that are sorted together


def extents(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, low, high, rows`` of the values that are numbers, one row a key."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(F.lit(1)).alias("rows"))


def bin_of(v: Column, low: Column, width: Column, bins: int) -> Column:
    """Number of the equal-width bin; all in the first where values do not differ."""
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1))
    return F.when(width > 0, F.greatest(at, F.lit(0))).otherwise(0).cast("int")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], bins: int = BINS,
              ends: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per ``keys``: ``keys, level, fraction, value``.

    ``level`` is the position in ``fractions``. Nulls and NaN are left out. ``ends`` are the ``extents``,
    if known. ``df`` is read twice if no key has more than ``few`` rows (once with ``ends``), else up to four
    times more: write it first if it is dear.
    """
    keys = list(keys)
    rows = df
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    known = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))) if ends is None else ends
    large, small = known.filter(F.col("rows") > few).select(*keys), known.filter(F.col("rows") <= few).select(*keys)
    if large.isEmpty():
        return _sorted(rows, keys, value, fractions)
    if small.isEmpty():
        return _selected(rows, keys, value, fractions, bins, ends)
    first = _sorted(attach(rows, small, row_bytes=64, on=keys, salt_by=(value,)), keys, value, fractions)
    ends = None if ends is None else ends.filter(F.col("rows") > few)
    return first.unionByName(_selected(attach(rows, large, row_bytes=64, on=keys, salt_by=(value,)), keys, value, fractions, bins, ends))


def _sorted(df: DataFrame, keys: list[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """``quantiles`` of keys of few values: one sorted array a key, of at most ``FEW`` values."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, (v + F.lit(0.0)).alias("_v"))               # one zero
    one = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    one = one.select(*keys, "_vs", F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), F.lit(float(q)).alias("fraction")) for i, q in enumerate(fractions)])).alias("want"))
    p = F.col("want.fraction") * (F.size("_vs") - 1)
    low, high = (F.get("_vs", f(p).cast("int")) for f in (F.floor, F.ceil))
    return one.select(*keys, "want.level", "want.fraction", (low + (high - low) * (p - F.floor(p))).alias("value"))


def _selected(df: DataFrame, keys: list[str], value: str, fractions: Sequence[float], bins: int, ends: DataFrame | None) -> DataFrame:
    """``quantiles`` of keys of any size, in two passes after the ``extents``."""
    ends = cut_lineage(extents(df, keys, value)) if ends is None else ends
    v = F.col("_v")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    at = bin_of(v, F.col("low"), (F.col("high") - F.col("low")) / bins, bins)

    # first pass: the histogram, at most ``bins`` rows a key, and the bins that hold a wanted rank
    hist = attach(rows, ends, on=keys, row_bytes=64, salt_by=("_v",)).groupBy(*keys, "rows", at.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(q)).alias("fraction")) for i, q in enumerate(fractions)])

    def place(w: Column) -> Column:
        return w["fraction"] * (F.col("rows") - 1)

    def held(first: Column, last: Column) -> Column:
        return F.filter(wanted, lambda w: (F.ceil(place(w)) >= first) & (F.floor(place(w)) <= last))

    chosen = cut_lineage(hist.filter(F.size(held(F.col("_before"), F.col("_before") + F.col("_n") - 1)) > 0))

    # second pass: only values of those bins (a bit each), counted and ranked
    one = F.lit(1).cast("long")
    bits = chosen.groupBy(*keys, F.floor(F.col("_bin") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", one, F.col("_bin") % 64)).alias("b"))
    words = bits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(-(-bins // 64) - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long")))
    facts = cut_lineage(ends.join(words, keys).select(*keys, "low", "high", mask.alias("_mask")))
    rows = attach(rows, facts, on=keys, row_bytes=bins // 8 + 128, salt_by=("_v",)).withColumn("_bin", at)
    bit = F.call_function("shiftright", F.get("_mask", F.floor(F.col("_bin") / 64).cast("int")), F.col("_bin") % 64).bitwiseAND(one)
    counts = rows.filter(bit == 1).groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counts, [*keys, "_bin"], None, ["_v"], {"cum": F.col("n")})
    ranked = ranked.join(chosen.select(*keys, "_bin", "_before", "rows"), [*keys, "_bin"])
    first, last = F.col("_before") + F.col("cum") - F.col("n"), F.col("_before") + F.col("cum") - 1
    hit = ranked.withColumns({"_first": first, "_last": last}).withColumn("want", F.explode(held(F.col("_first"), F.col("_last"))))
    p = place(F.col("want"))
    low = F.when(F.floor(p).between(F.col("_first"), F.col("_last")), F.col("_v"))
    high = F.when(F.ceil(p).between(F.col("_first"), F.col("_last")), F.col("_v"))
    found = hit.groupBy(*keys, "want").agg(F.max(low).alias("lo"), F.max(high).alias("hi"), F.max(p - F.floor(p)).alias("part"))
    return found.select(*keys, "want.level", "want.fraction", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def intensity_percentiles(voxels: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """Per scan: exact interpolated quantiles of ``hu``."""
    return quantiles(voxels, ["scan_id"], "hu", fractions)

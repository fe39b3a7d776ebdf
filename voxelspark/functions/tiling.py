"""Sliding-window arithmetic. Tiles and shapes are in (z, y, x) order."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TILE = (160, 320, 320)
DIVISOR = (32, 64, 64)
OVERLAP = 0.5
SIGMA_SCALE = 0.125
WEIGHT_FLOOR = 1e-3


def fit_tile(scans: DataFrame, tile: Sequence[int] | Column = TILE, divisor: Sequence[int] | Column = DIVISOR) -> DataFrame:
    """Adds tz, ty, tx: no larger than the volume, a multiple of the divisor, at least two of them.

    ``tile`` and ``divisor`` may be array columns: each scan's own."""
    own = lambda v, i: v[i] if isinstance(v, Column) else F.lit(int(v[i]))          # noqa: E731
    out = {}
    for i, a in enumerate("zyx"):
        t, d = own(tile, i), own(divisor, i)
        v = F.least(t, F.greatest(F.col(f"n{a}"), 2 * d))
        out[f"t{a}"] = F.greatest(2 * d, (F.floor(v / d) * d).cast("int"))
    return scans.withColumns(out)


def step_of(tile: Column, overlap: float = OVERLAP) -> Column:
    return F.greatest(F.lit(1), F.rint(tile * (1 - overlap)).cast("int"))


def starts(n: Column, tile: Column, overlap: float = OVERLAP) -> Column:
    """Window starts along one axis: regular steps plus one flush with the end."""
    last = n - tile
    regular = F.sequence(F.lit(0), last, step_of(tile, overlap))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(last)))


def tile_starts(tiles: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """One row per tile: z0, y0, x0 from n* and t*."""
    for a in "zyx":
        n, t = F.col(f"n{a}"), F.col(f"t{a}")
        tiles = tiles.withColumn(f"{a}0", F.explode(starts(F.greatest(n, t), t, overlap)))
    return tiles


def covering_starts(at: Column, n: Column, tile: int, overlap: float = OVERLAP) -> Column:
    """The starts of the windows holding position ``at``, by arithmetic."""
    step = max(1, round(tile * (1 - overlap)))
    n = F.greatest(n, F.lit(tile))
    last = n - tile
    first = F.greatest(F.ceil((at - tile + 1) / step), F.lit(0)).cast("int")
    final = F.least(F.floor(at / step), F.floor(last / step)).cast("int")
    regular = F.when(first <= final, F.sequence(first * step, final * step, F.lit(step)))
    regular = F.coalesce(regular, F.array().cast("array<int>"))
    flush = F.when((last % step != 0) & (at >= last), F.array(last.cast("int")))
    return F.concat(regular, F.coalesce(flush, F.array().cast("array<int>")))


def tile_weight(offset: Sequence[Column], tile: Sequence[int], sigma_scale: float = SIGMA_SCALE) -> Column:
    """Separable bell over the tile, relative to its largest sampled value, floored."""
    weight, top = F.lit(1.0), 1.0
    for d, n in zip(offset, tile):
        mid, s = (n - 1) / 2.0, max(n * sigma_scale, 1e-6)
        near = min(abs(i - mid) for i in range(n))
        weight = weight * F.exp(-((d - mid) * (d - mid)) / (2.0 * s * s))
        top *= math.exp(-(near * near) / (2.0 * s * s))
    return F.greatest(weight / top, F.lit(WEIGHT_FLOOR))

"""Scan geometry. Arrays are in (x, y, z) order; ``direction`` is a row-major 3x3."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
SIZE = ("nx", "ny", "nz")

# Fixed values.
SANE_SPACING_MM = (0.04, 1.2)
MAX_FOV_MM = 300.0
GRID_SPACING_MM = 0.3


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spacing_is_sane(spacing: str | Column = "spacing",
                    lo: float = SANE_SPACING_MM[0], hi: float = SANE_SPACING_MM[1]) -> Column:
    return F.forall(_col(spacing), lambda v: (v >= lo) & (v <= hi))


def validate_spacing(scans: DataFrame, lo: float = SANE_SPACING_MM[0],
                     hi: float = SANE_SPACING_MM[1]) -> DataFrame:
    """Adds ``accepted`` and, for refused scans, ``reason``."""
    ok = spacing_is_sane("spacing", lo, hi)
    text = F.concat(F.lit("voxel spacing outside "), F.lit(f"{lo}-{hi} mm"))
    return scans.withColumns({"accepted": ok, "reason": F.when(~ok, text)})


def field_of_view(scans: DataFrame) -> DataFrame:
    """Adds ``fov``: millimetres per axis to one decimal."""
    fov = F.array(*[F.bround(F.col(n) * F.col("spacing")[i], 1) for i, n in enumerate(SIZE)])
    return scans.withColumn("fov", fov)


def oversize_hint(scans: DataFrame, limit_mm: float = MAX_FOV_MM) -> DataFrame:
    """Adds ``max_fov`` and ``oversize``: no such scanner exists, so the spacing is suspect."""
    out = field_of_view(scans).withColumn("max_fov", F.array_max("fov"))
    return out.withColumn("oversize", F.col("max_fov") > limit_mm)


def grid_size(n: Column, spacing: Column, target: float) -> Column:
    return F.rint(n * spacing / F.lit(target)).cast("int")


def grid_plan(scans: DataFrame, spacing: float = GRID_SPACING_MM) -> DataFrame:
    """Size (``gx, gy, gz``) and voxel count of the isotropic grid, from the header alone."""
    out = scans.withColumns({f"g{a}": grid_size(F.col(n), F.col("spacing")[i], spacing)
                             for i, (a, n) in enumerate(zip(AXES, SIZE))})
    return out.withColumn("n_voxels", F.col("gx").cast("long") * F.col("gy") * F.col("gz"))


def to_physical(index: Sequence[Column], origin="origin", spacing="spacing",
                direction="direction") -> list[Column]:
    """Index (x, y, z) to patient millimetres: origin + D . (spacing * index)."""
    o, s, d = _col(origin), _col(spacing), _col(direction)
    step = [s[j] * index[j] for j in range(3)]
    return [o[i] + (d[3 * i] * step[0] + d[3 * i + 1] * step[1] + d[3 * i + 2] * step[2])
            for i in range(3)]


def _cofactors(d: Column) -> list[list[Column]]:
    def minor(i, j):
        r = [k for k in range(3) if k != i]
        c = [k for k in range(3) if k != j]
        m = d[3 * r[0] + c[0]] * d[3 * r[1] + c[1]] - d[3 * r[0] + c[1]] * d[3 * r[1] + c[0]]
        return m if (i + j) % 2 == 0 else -m
    return [[minor(i, j) for j in range(3)] for i in range(3)]


def determinant(direction="direction") -> Column:
    d = _col(direction)
    c = _cofactors(d)
    return d[0] * c[0][0] + d[1] * c[0][1] + d[2] * c[0][2]


def to_index(point: Sequence[Column], origin="origin", spacing="spacing",
             direction="direction") -> list[Column]:
    """Patient millimetres to continuous index (x, y, z)."""
    o, s, d = _col(origin), _col(spacing), _col(direction)
    cof, det = _cofactors(d), determinant(d)
    rel = [point[i] - o[i] for i in range(3)]
    return [(cof[0][j] * rel[0] + cof[1][j] * rel[1] + cof[2][j] * rel[2]) / det / s[j]
            for j in range(3)]


def frame_map(origin: str, spacing: str, direction: str, to_origin: str, to_spacing: str, to_direction: str) -> tuple[Column, Column]:
    """Matrix (9, row-major) and shift (3) that take a continuous index of one frame to the other's.

    Both frames may have any direction: the map runs through patient millimetres."""
    s, d, t = _col(spacing), _col(direction), _col(to_spacing)
    cof, det = _cofactors(_col(to_direction)), determinant(to_direction)
    back = [[cof[0][i], cof[1][i], cof[2][i]] for i in range(3)]              # row i of the inverse, times det
    matrix = [(back[i][0] * d[j] + back[i][1] * d[3 + j] + back[i][2] * d[6 + j]) / det * s[j] / t[i]
              for i in range(3) for j in range(3)]
    rel = [_col(origin)[i] - _col(to_origin)[i] for i in range(3)]
    shift = [(back[i][0] * rel[0] + back[i][1] * rel[1] + back[i][2] * rel[2]) / det / t[i] for i in range(3)]
    return F.array(*matrix), F.array(*shift)


def box_image(matrix: Sequence[Sequence[Column]], shift: Sequence[Column],
              lo: Sequence[Column], hi: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """Minimum and maximum of ``matrix . p + shift`` over the corners p of a box.

    A linear form over a box takes its extremes term by term, so the eight
    corners never have to be spelled out or exploded.
    """
    low, high = [], []
    for i in range(3):
        ends = [(matrix[i][j] * lo[j], matrix[i][j] * hi[j]) for j in range(3)]
        least = [F.least(a, b) for a, b in ends]
        most = [F.greatest(a, b) for a, b in ends]
        low.append(shift[i] + (least[0] + least[1] + least[2]))
        high.append(shift[i] + (most[0] + most[1] + most[2]))
    return low, high


def physical_bounds(scans: DataFrame) -> DataFrame:
    """Adds min_*/max_* of the eight outer corners (voxel edges included).

    The corners are expressions, not rows: nothing is exploded or shuffled.
    """
    s, d, o = F.col("spacing"), F.col("direction"), F.col("origin")
    low, high = box_image([[d[3 * i + j] for j in range(3)] for i in range(3)], [o[i] for i in range(3)],
                          [s[j] * -0.5 for j in range(3)],
                          [s[j] * (F.col(n) - 0.5) for j, n in enumerate(SIZE)])
    return scans.withColumns({f"min_{a}": low[i] for i, a in enumerate(AXES)}
                             | {f"max_{a}": high[i] for i, a in enumerate(AXES)})


def enclosing_box(boxes: DataFrame, matrix: str = "matrix", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Axis-aligned box (2 decimals) of a box moved by a row-major 4x4 ``matrix``."""
    m, a, b = F.col(matrix), F.col(lo), F.col(hi)
    low, high = box_image([[m[4 * r + c] for c in range(3)] for r in range(3)],
                          [m[4 * r + 3] for r in range(3)],
                          [a[i] for i in range(3)], [b[i] for i in range(3)])
    return boxes.withColumns({f"lo_{n}": F.bround(low[i], 2) for i, n in enumerate(AXES)}
                             | {f"hi_{n}": F.bround(high[i], 2) for i, n in enumerate(AXES)})


def crop_ranges(scans: DataFrame, box_lo: str = "box_lo", box_hi: str = "box_hi") -> DataFrame:
    """Half-open index ranges a*/b* of the grid-aligned box holding the drawn one.

    ``status`` is ``ok`` or ``no overlap`` (any side under two voxels). Corners
    of the drawn box may be given in any order.
    """
    p, q = F.col(box_lo), F.col(box_hi)
    lo = [F.least(p[i], q[i]) for i in range(3)]
    hi = [F.greatest(p[i], q[i]) for i in range(3)]
    o, s, cof = F.col("origin"), F.col("spacing"), _cofactors(F.col("direction"))
    det = determinant()
    back = [[cof[j][i] / det / s[i] for j in range(3)] for i in range(3)]
    low, high = box_image(back, [F.lit(0.0)] * 3, [lo[i] - o[i] for i in range(3)],
                          [hi[i] - o[i] for i in range(3)])
    out = {}
    for i, (a, n) in enumerate(zip(AXES, SIZE)):
        out[f"a{a}"] = F.greatest(F.floor(low[i] + 0.5), F.lit(0)).cast("int")
        out[f"b{a}"] = F.least(F.ceil(high[i] + 0.5), F.col(n)).cast("int")
    scans = scans.withColumns(out)
    thin = reduce(lambda u, v: u | v, [F.col(f"b{a}") - F.col(f"a{a}") < 2 for a in AXES])
    return scans.withColumn("status", F.when(thin, "no overlap").otherwise("ok"))


def lps_axes(direction="direction") -> list[Column]:
    """For each patient axis, the 0-based grid axis that runs along it.

    Grid axes are taken in order, each claiming its dominant patient axis among
    those still free.
    """
    d = _col(direction)
    def size(row, col):
        return F.abs(d[3 * row + col])
    def best(col, taken):
        key = [F.when(reduce(lambda u, v: u | v, [t == r for t in taken], F.lit(False)), F.lit(-1.0))
               .otherwise(size(r, col)) for r in range(3)]
        return (F.when((key[0] >= key[1]) & (key[0] >= key[2]), 0)
                .when(key[1] >= key[2], 1).otherwise(2))
    r0 = best(0, [])
    r1 = best(1, [r0])
    return [F.when(r0 == r, 0).when(r1 == r, 1).otherwise(2) for r in range(3)]


def _pick(parts: Sequence[Column], which: Column) -> Column:
    return F.when(which == 0, parts[0]).when(which == 1, parts[1]).otherwise(parts[2])


def orient_lps_headers(scans: DataFrame) -> DataFrame:
    """The header after permuting and flipping axes so the direction is nearest to
    identity. Adds ``axis`` (source grid axis per new axis) and ``flip``."""
    d, s = F.col("direction"), F.col("spacing")
    out = scans.withColumn("axis", F.array(*lps_axes()))
    ax = F.col("axis")
    out = out.withColumn("flip", F.array(*[F.element_at(d, 3 * r + ax[r] + 1) < 0 for r in range(3)]))
    flip = F.col("flip")
    sizes = F.array(*[F.col(n) for n in SIZE])
    last = [F.when(_pick([F.when(ax[r] == j, flip[r]) for r in range(3)], _where(ax, j)),
                   F.col(SIZE[j]) - 1).otherwise(0) for j in range(3)]
    origin = F.array(*to_physical(last))
    new_d = [F.element_at(d, 3 * i + ax[r] + 1) * F.when(flip[r], -1.0).otherwise(1.0)
             for i in range(3) for r in range(3)]
    return out.select(
        "scan_id", *[F.element_at(sizes, ax[r] + 1).alias(SIZE[r]) for r in range(3)],
        F.array(*[F.element_at(s, ax[r] + 1) for r in range(3)]).alias("spacing"),
        origin.alias("origin"), F.array(*new_d).alias("direction"), "axis", "flip")


def _where(ax: Column, j: int) -> Column:
    return F.when(ax[0] == j, 0).when(ax[1] == j, 1).otherwise(2)


def moved_index(axis: Column, flip: Column, sizes: Sequence[Column],
                index: Sequence[Column]) -> list[Column]:
    """Where an old index (x, y, z) lands after ``orient_lps_headers``; ``sizes`` are the new ones."""
    old = F.array(*index)
    out = []
    for r in range(3):
        v = F.element_at(old, axis[r] + 1)
        out.append(F.when(flip[r], sizes[r] - 1 - v).otherwise(v).cast("int"))
    return out

"""Header-level checks: validation, planning, boxes, orientation."""
from pyspark.sql import functions as F

from suites import check
from voxelspark.functions import geometry as G
from voxelspark.functions import tiling
from voxelspark.operators import crop

PHYS = """{o} + (d[{a}]*(sx*({x})) + d[{b}]*(sy*({y})) + d[{c}]*(sz*({z})))"""


def _phys(row, x, y, z):
    i = 3 * row + 1
    return PHYS.format(o=("ox", "oy", "oz")[row], a=i, b=i + 1, c=i + 2, x=x, y=y, z=z)


@check("f01_validate_spacing", """SELECT scan_id,
 least(sx, sy, sz) >= 0.04 AND greatest(sx, sy, sz) <= 1.2 AS accepted,
 case when not (least(sx, sy, sz) >= 0.04 AND greatest(sx, sy, sz) <= 1.2)
  then 'voxel spacing outside 0.04-1.2 mm' end AS reason FROM headers""")
def _(fx):
    return G.validate_spacing(fx.headers).select("scan_id", "accepted", "reason")


@check("f02_field_of_view", """SELECT scan_id, round_even(nx*sx, 1) AS fov_x, round_even(ny*sy, 1) AS fov_y,
 round_even(nz*sz, 1) AS fov_z FROM scans""")
def _(fx):
    return G.field_of_view(fx.scans).select("scan_id", *[F.col("fov")[i].alias(f"fov_{a}") for i, a in enumerate("xyz")])


@check("f03_oversize_hint", """SELECT scan_id, greatest(nx*sx, ny*sy, nz*sz) > 300.05 AS oversize,
 nx*sx > 300.05 OR ny*sy > 300.05 OR nz*sz > 300.05 AS any_axis FROM headers""")
def _(fx):
    out = G.oversize_hint(fx.headers)
    return out.select("scan_id", "oversize", F.exists("fov", lambda v: v > 300).alias("any_axis"))


@check("f04_grid_plan", """WITH g AS (SELECT scan_id, round_even(nx*sx/0.3::DOUBLE, 0) gx, round_even(ny*sy/0.3::DOUBLE, 0) gy,
  round_even(nz*sz/0.3::DOUBLE, 0) gz FROM headers)
 SELECT scan_id, gx, gy, gz, cast(gx*gy*gz as BIGINT) AS n_voxels FROM g""")
def _(fx):
    out = G.grid_plan(fx.headers)
    return out.select("scan_id", "gx", "gy", "gz", "n_voxels")


_IDX = """SELECT scan_id, z, y, x, round({0}, 6) AS px, round({1}, 6) AS py, round({2}, 6) AS pz,
 x::DOUBLE AS bx, y::DOUBLE AS "by", z::DOUBLE AS bz FROM jaw_labels JOIN headers USING (scan_id)"""


@check("f06_index_to_physical", _IDX.format(*[_phys(r, "x", "y", "z") for r in range(3)]))
def _(fx):
    from voxelspark.plans.attach import attach
    both = attach(fx.labels, fx.headers.select("scan_id", "origin", "spacing", "direction"))
    p = G.to_physical([F.col("x"), F.col("y"), F.col("z")])
    both = both.withColumns({"px": p[0], "py": p[1], "pz": p[2]})
    back = G.to_index([F.col("px"), F.col("py"), F.col("pz")])
    return both.select("scan_id", "z", "y", "x", *[F.round(c, 6).alias(c) for c in ("px", "py", "pz")],
                       *[F.round(b, 6).alias(n) for b, n in zip(back, ("bx", "by", "bz"))])


_CORNERS = "(values (0,0,0),(0,0,1),(0,1,0),(0,1,1),(1,0,0),(1,0,1),(1,1,0),(1,1,1)) t(i,j,k3)"


@check("f07_physical_bounds", """SELECT scan_id, """ + ", ".join(
    f"round({fn}({_phys(r, '-0.5 + i*nx', '-0.5 + j*ny', '-0.5 + k3*nz')}), 6) AS {fn}_{a}"
    for fn in ("min", "max") for r, a in enumerate("xyz")) + f" FROM headers, {_CORNERS} GROUP BY scan_id")
def _(fx):
    out = G.physical_bounds(fx.headers)
    return out.select("scan_id", *[F.round(f"{m}_{a}", 6).alias(f"{m}_{a}") for m in ("min", "max") for a in "xyz"])


BOX_SQL = """SELECT scan_id, ox - 3.1 + (scan_id % 5) AS lx, oy + 1.3::DOUBLE AS ly, oz + 0.7::DOUBLE AS lz,
 ox + 1.9 + (scan_id % 4) AS hx, oy + 0.4 * (scan_id % 9) AS hy, oz + 3.3::DOUBLE AS hz FROM scans"""


def boxes(fx):
    """A drawn box per scan, corners in no particular order; some miss the frame."""
    o, k = F.col("origin"), F.col("scan_id")
    return fx.scans.select(
        "scan_id", F.array(o[0] - 3.1 + k % 5, o[1] + 1.3, o[2] + 0.7).alias("box_lo"),
        F.array(o[0] + 1.9 + k % 4, o[1] + 0.4 * (k % 9), o[2] + 3.3).alias("box_hi"))


_RANGES = f"""box AS ({BOX_SQL}), rng AS (SELECT s.scan_id, s.nx,
 greatest(floor(least((lx-ox)/dxx, (hx-ox)/dxx)/sx + 0.5), 0) AS ax, least(ceil(greatest((lx-ox)/dxx, (hx-ox)/dxx)/sx + 0.5), nx) AS bx,
 greatest(floor((least(ly,hy)-oy)/sy + 0.5), 0) AS ay, least(ceil((greatest(ly,hy)-oy)/sy + 0.5), ny) AS "by",
 greatest(floor((least(lz,hz)-oz)/sz + 0.5), 0) AS az, least(ceil((greatest(lz,hz)-oz)/sz + 0.5), nz) AS bz
 FROM scans s JOIN box USING (scan_id))"""


@check("f08_crop_ranges", f"""WITH {_RANGES} SELECT scan_id, ax, bx, ay, "by", az, bz,
 case when bx-ax < 2 or "by"-ay < 2 or bz-az < 2 then 'no overlap' else 'ok' end AS status FROM rng""")
def _(fx):
    out = G.crop_ranges(fx.scans.join(boxes(fx), "scan_id"))
    return out.select("scan_id", "ax", "bx", "ay", "by", "az", "bz", "status")


@check("f08_crop_to_box", f"""WITH {_RANGES} SELECT v.scan_id, z, y, x, hu FROM voxels v JOIN rng USING (scan_id)
 WHERE bx-ax >= 2 and "by"-ay >= 2 and bz-az >= 2 and x >= ax and x < bx and y >= ay and y < "by" and z >= az and z < bz""")
def _(fx):
    return crop.crop_to_box(fx.voxels, fx.scans, boxes(fx))


@check("f09_enclosing_box", """WITH c AS (SELECT scan_id, i*(4 + scan_id%6) - 1.5 AS cx, j*(3 + scan_id%4) + 0.25 AS cy,
  k3*(2 + scan_id%3)::DOUBLE AS cz, scan_id%10 AS tx FROM scans, """ + _CORNERS + """),
 m AS (SELECT scan_id, 0.8*cx - 0.6*cy + tx AS mx, 0.6*cx + 0.8*cy - 2 AS my, 1.5*cz + 0.5 AS mz FROM c)
 SELECT scan_id, round(min(mx),2)::DOUBLE AS lo_x, round(min(my),2)::DOUBLE AS lo_y, round(min(mz),2)::DOUBLE AS lo_z,
 round(max(mx),2)::DOUBLE AS hi_x, round(max(my),2)::DOUBLE AS hi_y, round(max(mz),2)::DOUBLE AS hi_z FROM m GROUP BY scan_id""")
def _(fx):
    k = F.col("scan_id")
    box = fx.scans.select(
        "scan_id", F.array(F.lit(-1.5), F.lit(0.25), F.lit(0.0)).alias("lo"),
        F.array(k % 6 + 2.5, k % 4 + 3.25, k % 3 + 2.0).alias("hi"),
        F.array(*[F.lit(v) for v in (0.8, -0.6, 0.0)], (k % 10).cast("double"),
                *[F.lit(v) for v in (0.6, 0.8, 0.0, -2.0, 0.0, 0.0, 1.5, 0.5, 0.0, 0.0, 0.0, 1.0)]).alias("matrix"))
    return G.enclosing_box(box).select("scan_id", *[f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"])


# Each scan's headers cycle through four directions, so the expected turn is known per case.
@check("f11_orient_lps_headers", f"""SELECT scan_id, nx, ny, nz, sx, sy, sz, round(ox, 6) AS ox, round(oy, 6) AS oy,
 round(oz, 6) AS oz, case scan_id % 4 when 3 then '0.8,-0.6,0.0,0.6,0.8,0.0,0.0,0.0,1.0'
  else '1.0,0.0,0.0,0.0,1.0,0.0,0.0,0.0,1.0' end AS direction FROM (
 SELECT scan_id, nx, ny, nz, sx, sy, sz, ox, oy, oz FROM headers WHERE scan_id % 4 IN (0, 3)
 UNION ALL SELECT scan_id, nx, ny, nz, sx, sy, sz, ox - sx*(nx-1), oy - sy*(ny-1), oz FROM headers WHERE scan_id % 4 = 1
 UNION ALL SELECT scan_id, ny, nz, nx, sy, sz, sx, ox, oy - sz*(nz-1), oz FROM headers WHERE scan_id % 4 = 2)""")
def _(fx):
    out = G.orient_lps_headers(fx.headers)
    text = F.array_join(F.transform("direction", lambda v: (v + 0.0).cast("string")), ",")
    return out.select("scan_id", "nx", "ny", "nz", *[F.col("spacing")[i].alias(f"s{a}") for i, a in enumerate("xyz")],
                      *[F.round(F.col("origin")[i], 6).alias(f"o{a}") for i, a in enumerate("xyz")],
                      text.alias("direction"))


@check("f11_orient_lps", """SELECT scan_id, z, y, case when scan_id % 7 = 0 then 15 - x else x end AS x, hu FROM voxels""")
def _(fx):
    return crop.orient_lps(fx.voxels, fx.scans)


@check("f21_fit_tile", """SELECT scan_id,
 greatest(64, floor(least(160, greatest(nz, 64))/32)*32) AS tz,
 greatest(128, floor(least(320, greatest(ny, 128))/64)*64) AS ty,
 greatest(128, floor(least(320, greatest(nx, 128))/64)*64) AS tx FROM headers""")
def _(fx):
    return tiling.fit_tile(fx.headers).select("scan_id", "tz", "ty", "tx")


_STARTS = """st AS (SELECT scan_id, a, n, t, unnest(case when n <= t then [0] else list_distinct(list_concat(range(0, n - t + 1, t//2), [n - t])) end) AS s
 FROM (SELECT scan_id, unnest(['z','y','x']) AS a, unnest([nz, ny, nx]) AS n, unnest([tz, ty, tx]) AS t FROM (SELECT scan_id, nz, ny, nx,
  cast(greatest(64, floor(least(160, greatest(nz, 64))/32)*32) as INT) AS tz, cast(greatest(128, floor(least(320, greatest(ny, 128))/64)*64) as INT) AS ty,
  cast(greatest(128, floor(least(320, greatest(nx, 128))/64)*64) as INT) AS tx FROM headers)))"""


@check("t01_tile_starts", f"""WITH {_STARTS} SELECT a.scan_id, a.s AS z0, b.s AS y0, c.s AS x0
 FROM st a JOIN st b USING (scan_id) JOIN st c USING (scan_id) WHERE a.a = 'z' AND b.a = 'y' AND c.a = 'x'""")
def _(fx):
    return tiling.tile_starts(tiling.fit_tile(fx.headers)).select("scan_id", "z0", "y0", "x0")


@check("t03_tile_weight", """SELECT scan_id, z, y, x, round(greatest(
 exp(-((z%8-3.5)*(z%8-3.5))/(2*1*1)) * exp(-((y%12-5.5)*(y%12-5.5))/(2*1.5*1.5)) * exp(-((x%16-7.5)*(x%16-7.5))/(2*2*2))
 / (exp(-0.25/2) * exp(-0.25/4.5) * exp(-0.25/8)), 0.001), 6) AS w FROM jaw_labels""")
def _(fx):
    w = tiling.tile_weight([F.col(a) % n for a, n in zip("zyx", (8, 12, 16))], (8, 12, 16))
    return fx.labels.select("scan_id", "z", "y", "x", F.round(w, 6).alias("w"))

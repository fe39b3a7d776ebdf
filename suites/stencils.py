"""Resampling, neighbourhood and surface checks."""
from pyspark.sql import functions as F

from suites import check, digest, digest_sql
from suites.fixtures import EDGE
from voxelspark.operators import blocks, crop, halo, resample, stencil, surface
from voxelspark.operators.tiles import KEYS


def _axis_sql(out, src, axis):
    a, b = [c for c in "zyx" if c != axis]
    return f"""{out} AS (SELECT l.scan_id, l.{a}, l.{b}, t.t AS {axis}, case when t.p >= 15.5 then -1000 when t.i >= 15 then l.v
 else l.v + (r.v - l.v)*(t.p - t.i) end AS v FROM tgt t JOIN {src} l ON l.scan_id = t.scan_id AND l.{axis} = least(t.i, 15)
 LEFT JOIN {src} r ON r.scan_id = l.scan_id AND r.{a} = l.{a} AND r.{b} = l.{b} AND r.{axis} = l.{axis} + 1)"""


_RESAMPLED = """tgt AS (SELECT scan_id, t, t*{sp}::DOUBLE/sx AS p, floor(t*{sp}::DOUBLE/sx)::INT AS i FROM scans, range(200) r(t)
  WHERE t < round_even(16*sx/{sp}::DOUBLE, 0)), """ + ",\n".join([
    _axis_sql("ax", "src", "x"), _axis_sql("axy", "ax", "y"), _axis_sql("axyz", "axy", "z")])


@check("r01_resample_linear", "WITH src AS (SELECT scan_id, z, y, x, hu::DOUBLE AS v FROM voxels),\n"
       + _RESAMPLED.format(sp="0.3") + "\n" + digest_sql("axyz", "cast(round_even(v * 1000, 0) AS BIGINT)"))
def _(fx):
    out = resample.resample_linear(fx.voxels, fx.scans)
    return digest(out, F.rint(F.col("hu") * 1000).cast("long"))


@check("r02_resample_nearest", """WITH t AS (SELECT scan_id, t, sx, dxx FROM scans, range(24) r(t)),
 tx AS (SELECT scan_id, t, floor((t*(sx*0.7) + dxx*(0.31*sx))/sx + 0.5 + 1e-9) AS g FROM t), ty AS (SELECT scan_id, t, floor((t*(sx*0.7))/sx + 0.5 + 1e-9) AS g FROM t)
 SELECT l.scan_id, c.t AS z, b.t AS y, a.t AS x, label FROM jaw_labels l JOIN tx a ON a.scan_id = l.scan_id AND a.g = l.x
 JOIN ty b ON b.scan_id = l.scan_id AND b.g = l.y JOIN ty c ON c.scan_id = l.scan_id AND c.g = l.z""".replace("*0.7", "*0.7::DOUBLE").replace("0.31*", "0.31::DOUBLE*"))
def _(fx):
    s, o = F.col("spacing"), F.col("origin")
    ref = fx.scans.select("scan_id", F.lit(24).alias("nx"), F.lit(24).alias("ny"), F.lit(24).alias("nz"),
                          F.transform(s, lambda v: v * 0.7).alias("spacing"),
                          F.array(o[0] + 0.31 * s[0], o[1], o[2]).alias("origin"), "direction")
    grid = fx.scans
    return resample.resample_nearest(fx.labels, grid, ref)


def _smooth_sql(out, src, axis):
    a, b = [c for c in "zyx" if c != axis]
    return f"""{out} AS (SELECT scan_id, {a}, {b}, unnest(range(16)) AS {axis}, unnest(list_transform(range(16), lambda i:
 list_sum(list_transform(range(-r, r + 1), lambda j: w[abs(j) + 1]*line[greatest(0, least(15, i + j)) + 1]))))/(2*list_sum(w) - w[1]) AS v
 FROM (SELECT scan_id, {a}, {b}, list(v ORDER BY {axis}) AS line FROM {src} GROUP BY ALL) JOIN ker USING (scan_id))"""


@check("r03_gaussian_smooth", """WITH src AS (SELECT scan_id, z, y, x, hu::DOUBLE AS v FROM voxels),
 ker AS (SELECT scan_id, r, list_transform(range(0, r + 1), lambda j: exp(-(j*sx)*(j*sx)/(2*0.6::DOUBLE*0.6::DOUBLE))) AS w
  FROM (SELECT scan_id, sx, ceil(1.8::DOUBLE/sx)::INT AS r FROM scans)),
 """ + ",\n".join([_smooth_sql("sx1", "src", "x"), _smooth_sql("sx2", "sx1", "y"), _smooth_sql("sx3", "sx2", "z")])
       + "\nSELECT scan_id, count(*) AS n, round(sum(v), 3) AS total, round(sum(v*(z*10007 + y*101 + x))/1000, 2) AS weighted FROM sx3 GROUP BY scan_id")
def _(fx):
    out = blocks.voxels_of(halo.gaussian_blocks(fx.blocks, fx.scans, block=EDGE), "hu")
    return out.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("hu"), 3).alias("total"),
        F.round(F.sum(F.col("hu") * (F.col("z") * 10007 + F.col("y") * 101 + F.col("x"))) / 1000, 2).alias("weighted"))


@check("r04_pad_edge", "WITH p AS (SELECT scan_id, a.i AS z, y, b.i AS x, hu::BIGINT AS h FROM voxels JOIN range(20) a(i) ON least(a.i, 15) = z JOIN range(18) b(i) ON least(b.i, 15) = x)\n"
       + digest_sql("p", "h"))
def _(fx):
    return digest(crop.pad_edge(fx.voxels, fx.scans, (20, 16, 18)), F.col("hu").cast("long"))


@check("r05_dilate", """WITH o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-3, 4) a(i), range(-3, 4) b(i), range(-3, 4) c(i) WHERE a.i*a.i + b.i*b.i + c.i*c.i <= 12.25)
 SELECT DISTINCT scan_id, z + dz AS z, y + dy AS y, x + dx AS x FROM jaw_labels, o WHERE label = 3
 AND z + dz BETWEEN 0 AND 15 AND y + dy BETWEEN 0 AND 15 AND x + dx BETWEEN 0 AND 15""")
def _(fx):
    return stencil.dilate(fx.labels.filter("label = 3"), fx.scans).select(*KEYS)


CONTACTS = """fc AS (SELECT l.scan_id, l.label AS a, coalesce(m.label, 0) AS b FROM jaw_labels l
  JOIN (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx)
  ON l.z + dz BETWEEN 0 AND 15 AND l.y + dy BETWEEN 0 AND 15 AND l.x + dx BETWEEN 0 AND 15
  LEFT JOIN jaw_labels m ON m.scan_id = l.scan_id AND m.z = l.z + dz AND m.y = l.y + dy AND m.x = l.x + dx)"""


@check("r06_contacts", f"WITH {CONTACTS} SELECT scan_id, a, b, count(*) AS faces FROM fc WHERE a <> b GROUP BY ALL")
def _(fx):
    return stencil.contacts(fx.labels, fx.scans)


@check("r07_nearest_label", """WITH o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx, 36*(a.i*a.i + b.i*b.i + c.i*c.i) AS d2
   FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i) WHERE a.i*a.i + b.i*b.i + c.i*c.i <= 4),
 r AS (SELECT s.scan_id, s.z + dz AS z, s.y + dy AS y, s.x + dx AS x, d2, s.id FROM tooth_pred s, o)
 SELECT scan_id, z, y, x, round(sqrt(min(d2)), 6) AS distance, arg_min(id, d2*100 + id) AS near FROM jaw_labels JOIN r USING (scan_id, z, y, x) GROUP BY ALL""")
def _(fx):
    out = stencil.nearest_label(fx.tooth_pred, fx.labels.select(*KEYS), fx.qc_scans, 12.0, "id")
    return out.withColumn("distance", F.round("distance", 6))


@check("r08_coverage_mask", """WITH g AS (SELECT scan_id, sx AS s, 0.25::DOUBLE AS fs, 1.1::DOUBLE*sx AS fo, 10 + scan_id % 9 AS fn FROM scans),
 c AS (SELECT l.scan_id, z, y, x, label, (z*s - fo)/fs AS cz, (y*s - fo)/fs AS cy, (x*s - fo)/fs AS cx, fn FROM jaw_labels l JOIN g USING (scan_id))
 SELECT scan_id, z, y, x, label FROM c WHERE x < 8 AND cz >= -0.5 AND cz < fn - 0.5 AND cy >= -0.5 AND cy < fn - 0.5 AND cx >= -0.5 AND cx < fn - 0.5""")
def _(fx):
    grid = fx.scans.select("scan_id", "nx", "ny", "nz", "spacing", F.array(*[F.lit(0.0)] * 3).alias("origin"))
    n = (10 + F.col("scan_id") % 9).cast("int")
    sub = fx.scans.select("scan_id", *[n.alias(f"sub_n{a}") for a in "xyz"],
                          F.array(*[F.lit(0.25)] * 3).alias("sub_spacing"),
                          F.array(*[F.lit(1.1) * F.col("spacing")[0]] * 3).alias("sub_origin"),
                          F.lit(0).alias("half_lo"), F.lit(8).alias("half_hi"))
    ranges = crop.coverage_ranges(grid, sub, x_range=True)
    return crop.within(fx.labels, ranges, sized_by=fx.scans)


def _edge_sql(axis):
    """Crossings along one axis: a voxel and the next one of its line."""
    others = ", ".join(a for a in "zyx" if a != axis)
    at = ", ".join(f"{a} + (400 - v)/(w - v) AS e{a}" if a == axis else f"{a}::DOUBLE AS e{a}" for a in "xyz")
    return (f"SELECT scan_id, '{axis}' AS axis, {at} FROM (SELECT scan_id, z, y, x, hu::DOUBLE AS v, lead(hu::DOUBLE) OVER (PARTITION BY scan_id, {others} ORDER BY {axis}) AS w "
            "FROM voxels) WHERE (v >= 400) <> (w >= 400)")


_EDGES = f"""ed AS ({' UNION ALL '.join(map(_edge_sql, 'zyx'))}),
 vx AS (SELECT e.scan_id, axis, ox + dxx*(sx*ex) AS x, oy + sy*ey AS y, oz + sz*ez AS z FROM ed e JOIN scans USING (scan_id))"""


@check("r09_iso_vertices", f"WITH {_EDGES} SELECT scan_id, axis, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vx")
def _(fx):
    out = surface.iso_vertices(fx.voxels, fx.scans, 400.0)
    return out.select("scan_id", "axis", *[F.round(c, 6).alias(c) for c in "xyz"])


@check("f10_fit_box", f"""WITH {_EDGES} SELECT scan_id, round(min(x) - 3, 6) AS lo_x, round(min(y) - 3, 6) AS lo_y, round(min(z) - 3, 6) AS lo_z,
 round(max(x) + 3, 6) AS hi_x, round(max(y) + 3, 6) AS hi_y, round(max(z) + 3, 6) AS hi_z FROM vx GROUP BY scan_id""")
def _(fx):
    out = crop.fit_box(surface.iso_vertices(fx.voxels, fx.scans, 400.0))
    return out.select("scan_id", *[F.round(f"{e}_{a}", 6).alias(f"{e}_{a}") for e in ("lo", "hi") for a in "xyz"])


_CORNERS = ", ".join(f"JOIN voxels c{i} ON c{i}.scan_id = c0.scan_id AND c{i}.z = c0.z + {i >> 2 & 1} AND c{i}.y = c0.y + {i >> 1 & 1} AND c{i}.x = c0.x + {i & 1}"
                     for i in range(1, 8)).replace(", JOIN", " JOIN")


def _dot(u, v):
    return " + ".join(f"({u}[{i}])*({v}[{i}])" for i in (1, 2, 3))


def _cross_sql(u, v):
    return "[" + ", ".join(f"{u}[{a}]*{v}[{b}] - {u}[{b}]*{v}[{a}]" for a, b in ((2, 3), (3, 1), (1, 2))) + "]"


_BIT = {"x": 1, "y": 2, "z": 4}
_STEP = {a: f"(((q[2] & {b}) > 0)::INT - ((q[1] & {b}) > 0)::INT)" for a, b in _BIT.items()}
_AT = {a: f"({a} + ((q[1] & {b}) > 0)::INT + {_STEP[a]}*(400 - v[q[1] + 1])/(v[q[2] + 1] - v[q[1] + 1]))" for a, b in _BIT.items()}


# a triangle or two for each tetrahedron the surface passes, turned so that normals point from the inside out
@check("r10_iso_triangles", f"""WITH t AS (SELECT c0.scan_id, c0.x, c0.y, c0.z, [{', '.join(f'c{i}.hu::DOUBLE' for i in range(8))}] AS v FROM voxels c0 {_CORNERS}),
 s AS (SELECT t.*, list_filter(tet, lambda c: v[c + 1] >= 400) AS i, list_filter(tet, lambda c: v[c + 1] < 400) AS o FROM t,
  (SELECT unnest([[0,1,3,7],[0,1,5,7],[0,2,3,7],[0,2,6,7],[0,4,5,7],[0,4,6,7]]) AS tet) WHERE list_min(v) < 400 AND list_max(v) >= 400),
 e AS (SELECT scan_id, x, y, z, v, unnest(case len(i) when 2 then [[[i[1],o[1]],[i[1],o[2]],[i[2],o[2]]],[[i[1],o[1]],[i[2],o[2]],[i[2],o[1]]]]
  when 1 then [[[i[1],o[1]],[i[1],o[2]],[i[1],o[3]]]] when 3 then [[[i[1],o[1]],[i[2],o[1]],[i[3],o[1]]]] else [] end) AS e FROM s),
 p AS (SELECT e.scan_id, list_transform(e, lambda q: [ox + dxx*sx*{_AT['x']}, oy + sy*{_AT['y']}, oz + sz*{_AT['z']}]) AS p,
  list_transform(e[1:1], lambda q: [dxx*sx*{_STEP['x']}, sy*{_STEP['y']}, sz*{_STEP['z']}])[1] AS away FROM e JOIN scans USING (scan_id)),
 d AS (SELECT *, list_transform(range(1, 4), lambda k: p[2][k] - p[1][k]) AS a, list_transform(range(1, 4), lambda k: p[3][k] - p[1][k]) AS b FROM p),
 n AS (SELECT *, {_cross_sql('a', 'b')} AS n, {_cross_sql('p[2]', 'p[3]')} AS w FROM d)
 SELECT scan_id, count(*) AS triangles, round(sum(sqrt({_dot('n', 'n')})/2), 3) AS area_mm2,
  round(sum(case when {_dot('n', 'away')} >= 0 then 1 else -1 end * ({_dot('p[1]', 'w')})/6), 3) AS volume_mm3,
  {', '.join(f"round(min(least(p[1][{k}], p[2][{k}], p[3][{k}])), 3) AS min_{a}, round(max(greatest(p[1][{k}], p[2][{k}], p[3][{k}])), 3) AS max_{a}" for k, a in enumerate("xyz", 1))}
 FROM n GROUP BY scan_id""")
def _(fx):
    out = surface.mesh_facts(surface.iso_triangles(fx.voxels, fx.scans, 400.0))
    return out.select("scan_id", "triangles", *[F.round(c, 3).alias(c) for c in out.columns if c not in ("scan_id", "triangles")])


@check("r10_iso_triangle_counts", f"""WITH t AS (SELECT c0.scan_id, [{', '.join(f'(c{i}.hu >= 400)::INT' for i in range(8))}] AS f FROM voxels c0 {_CORNERS}),
 u AS (SELECT scan_id, list_sum(list_transform(tet, lambda c: f[c + 1])) AS inside FROM t,
  (SELECT unnest([[0,1,3,7],[0,1,5,7],[0,2,3,7],[0,2,6,7],[0,4,5,7],[0,4,6,7]]) AS tet) WHERE list_sum(f) BETWEEN 1 AND 7)
 SELECT scan_id, sum(case inside when 2 then 2 when 1 then 1 when 3 then 1 else 0 end)::BIGINT AS triangles FROM u GROUP BY scan_id""")
def _(fx):
    return surface.iso_triangles(fx.voxels, fx.scans, 400.0).groupBy("scan_id").agg(F.count(F.lit(1)).alias("triangles"))


_SOUP = """soup AS (SELECT scan_id AS mesh_id, (z*256 + y*16 + x)*2 + t AS tri, c AS corner, (x + case when (t, c) IN ((0,1),(1,0),(1,1)) then 1 else 0 end)::DOUBLE AS x,
  (y + case when (t, c) IN ((0,2),(1,1),(1,2)) then 1 else 0 end)::DOUBLE AS y, (z + 1)::DOUBLE AS z FROM jaw_labels, range(2) a(t), range(3) b(c) WHERE label = 5),
 vt AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY x, y, z) - 1 AS vertex FROM (SELECT DISTINCT mesh_id, x, y, z FROM soup))"""


def _soup(fx):
    can = fx.labels.filter("label = 5").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn(
        "corner", F.explode(F.sequence(F.lit(0), F.lit(2))))
    tc = F.col("t") * 3 + F.col("corner")
    return can.select(F.col("scan_id").alias("mesh_id"), ((F.col("z") * 256 + F.col("y") * 16 + F.col("x")) * 2 + F.col("t")).alias("tri"),
                      "corner", (F.col("x") + tc.isin(1, 3, 4).cast("int")).cast("double").alias("x"),
                      (F.col("y") + tc.isin(2, 4, 5).cast("int")).cast("double").alias("y"), (F.col("z") + 1).cast("double").alias("z"))


@check("r11_weld_vertices", f"WITH {_SOUP} SELECT mesh_id, vertex, x, y, z FROM vt")
def _(fx):
    return surface.weld_vertices(_soup(fx))[0]


@check("r11_weld_faces", f"""WITH {_SOUP} SELECT mesh_id, tri, max(vertex) FILTER (corner = 0) AS v0, max(vertex) FILTER (corner = 1) AS v1,
 max(vertex) FILTER (corner = 2) AS v2 FROM soup JOIN vt USING (mesh_id, x, y, z) GROUP BY ALL""")
def _(fx):
    return surface.weld_vertices(_soup(fx))[1]

"""Intensity expressions, quantiles, thresholds and matching."""
from pyspark.sql import functions as F

from suites import check, digest, digest_sql
from voxelspark.functions import intensity as I
from voxelspark.operators import histogram, matching, quantiles

_NORM = "(least(greatest(hu::DOUBLE, -1000), 3492) - 656.9095458984375::DOUBLE) / 1074.9185791015625::DOUBLE"


@check("f12_normalize_ct", digest_sql("voxels", f"cast(round_even({_NORM} * 1000000, 0) AS BIGINT)"))
def _(fx):
    return digest(fx.voxels, F.rint(I.normalize_ct(F.col("hu")) * 1000000).cast("long"))


@check("f13_denormalize", digest_sql("voxels", f"cast(round_even((({_NORM}) * 1074.9185791015625::DOUBLE + 656.9095458984375::DOUBLE) * 1000, 0) AS BIGINT)"))
def _(fx):
    return digest(fx.voxels, F.rint(I.denormalize(I.normalize_ct(F.col("hu"))) * 1000).cast("long"))


_DENS = """SELECT scan_id, round(case when d <= 50 then low + (auto - low)*d/50 else auto + (high - auto)*(d - 50)/50 end, 6) AS threshold
 FROM (SELECT scan_id, (scan_id%50 - 500)::DOUBLE AS low, (300 + scan_id%200)::DOUBLE AS auto, (1500 + scan_id%300)::DOUBLE AS high,
 least(greatest(((scan_id*13)%131 - 10)::DOUBLE, 0), 100) AS d FROM scans)"""


@check("f14_density_to_threshold", _DENS)
def _(fx):
    k = F.col("scan_id")
    thr = I.density_to_threshold((k * 13) % 131 - 10, (k % 50 - 500).cast("double"),
                                 (k % 200 + 300).cast("double"), (k % 300 + 1500).cast("double"))
    return fx.scans.select("scan_id", F.round(thr, 6).alias("threshold"))


@check("f16_threshold_mask", "SELECT scan_id, z, y, x FROM voxels WHERE hu > 1300")
def _(fx):
    return fx.voxels.filter(I.above(F.col("hu"), 1300)).select("scan_id", "z", "y", "x")


QS = [i / 16 for i in range(17)] + [0.995]


@check("a01_intensity_percentiles", f"""SELECT scan_id, unnest(range(18)) AS level,
 unnest(list_transform(quantile_cont(hu::DOUBLE, {QS}), lambda v: round(v, 6))) AS value FROM voxels GROUP BY scan_id""")
def _(fx):
    out = quantiles.intensity_percentiles(fx.voxels, QS)
    return out.select("scan_id", "level", F.round("value", 6).alias("value"))


FINE = """half AS (SELECT scan_id, z, y, x, v FROM (SELECT scan_id, z, y, x, hu::DOUBLE + (z*z*z*31 + y*y*17 + x*7 + z*y*x) % 4093 / 4096.0::DOUBLE AS v FROM voxels))"""


@check("a01_percentiles_of_a_float_grid", f"""WITH {FINE} SELECT scan_id, unnest(range(18)) AS level,
 unnest(list_transform(quantile_cont(v, {QS}), lambda v: round(v, 9))) AS value FROM half GROUP BY scan_id""")
def _(fx):
    fine = F.col("hu").cast("double") + F.expr("(z*z*z*31 + y*y*17 + x*7 + z*y*x) % 4093 / 4096D")
    out = quantiles.intensity_percentiles(fx.voxels.withColumn("hu", fine), QS)
    return out.select("scan_id", "level", F.round("value", 9).alias("value"))


CURVE_Q = [i / 32 for i in range(33)]
CURVE_HU = [-1000.0 + 60.0 * i + 1.5 * i * i for i in range(33)]


@check("a02_match_quantiles", f"""WITH q AS (SELECT scan_id, unnest(range(33)) AS level, unnest(quantile_cont(hu::DOUBLE, {CURVE_Q})) AS x0
  FROM voxels GROUP BY scan_id),
 k AS (SELECT scan_id, x0, -1000 + 60.0*min(level) + 1.5*min(level)*min(level) AS y0 FROM q GROUP BY ALL),
 p AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY scan_id ORDER BY x0)),
 d AS (SELECT DISTINCT scan_id, hu::DOUBLE AS v FROM voxels),
 m AS (SELECT d.scan_id, d.v, case when x1 is null then y0 else (y1-y0)/(x1-x0)*(v-x0)+y0 end::DOUBLE AS w FROM d ASOF JOIN p ON d.scan_id = p.scan_id AND d.v >= p.x0),
 r AS (SELECT v.scan_id, z, y, x, w FROM voxels v JOIN m ON v.scan_id = m.scan_id AND v.hu = m.v)
 """ + digest_sql("r", "cast(round_even(w * 1000, 0) AS BIGINT)"))
def _(fx):
    out = matching.match_quantiles(fx.voxels, CURVE_Q, CURVE_HU)
    return digest(out, F.rint(F.col("matched") * 1000).cast("long"))


@check("a03_reference_curve", f"""WITH jaw AS (SELECT scan_id, greatest(min(z)-2, 0) az, least(max(z)+3, 16) bz, greatest(min(y)-2, 0) ay, least(max(y)+3, 16) b_y,
  greatest(min(x)-2, 0) ax, least(max(x)+3, 16) bx FROM jaw_labels WHERE label = 1 GROUP BY scan_id),
 c AS (SELECT v.scan_id, hu::DOUBLE AS hu FROM voxels v JOIN jaw j USING (scan_id) WHERE z >= az AND z < bz AND y >= ay AND y < b_y AND x >= ax AND x < bx),
 q AS (SELECT scan_id, unnest(range(65)) AS level, unnest(quantile_cont(hu, {[i / 64 for i in range(65)]})) AS v FROM c GROUP BY scan_id)
 SELECT level, level/64.0::DOUBLE AS fraction, round_even(quantile_cont(v, 0.5), 1) AS hu, count(*) AS built_from FROM q GROUP BY level""")
def _(fx):
    return matching.reference_curve(fx.voxels, fx.labels, fx.scans, levels=64, margin=2)


_INSIDE = """ins AS (SELECT *, hu::DOUBLE AS v FROM (SELECT *, min(hu) OVER (PARTITION BY scan_id) AS lo FROM voxels) WHERE hu > lo + 1)"""


@check("a04_otsu_thresholds", f"""WITH {_INSIDE},
 e AS (SELECT scan_id, min(v) AS first, (max(v) - min(v) + (max(v) - min(v))/256/100.0::DOUBLE)/256 AS width, quantile_cont(v, 0.995) AS top FROM ins GROUP BY scan_id),
 h0 AS (SELECT scan_id, least(floor((v - first)/width), 255)::INT AS bin, count(*) AS n FROM ins JOIN e USING (scan_id) GROUP BY ALL),
 hh AS (SELECT g.scan_id, g.b AS bin, coalesce(n, 0) AS n FROM (SELECT scan_id, b FROM e, range(256) t(b)) g LEFT JOIN h0 ON h0.scan_id = g.scan_id AND h0.bin = g.b),
 c AS (SELECT scan_id, bin, sum(n) OVER w AS cw, sum(n*bin) OVER w AS cs FROM hh WINDOW w AS (PARTITION BY scan_id ORDER BY bin)),
 t AS (SELECT scan_id, max(cw) AS tw, max(cs) AS ts FROM c GROUP BY scan_id),
 p AS (SELECT a.scan_id, a.bin AS i, b.bin AS j,
  case when a.cw > 0 then a.cs::DOUBLE*a.cs/a.cw else 0 end
  + case when b.cw > a.cw then (b.cs-a.cs)::DOUBLE*(b.cs-a.cs)/(b.cw-a.cw) else 0 end
  + case when tw > b.cw then (ts-b.cs)::DOUBLE*(ts-b.cs)/(tw-b.cw) else 0 end AS score
  FROM c a JOIN c b ON a.scan_id = b.scan_id AND a.bin < b.bin AND b.bin < 255 JOIN t ON t.scan_id = a.scan_id),
 best AS (SELECT DISTINCT ON (scan_id) scan_id, i, j FROM p ORDER BY scan_id, score DESC, i, j)
 SELECT scan_id, round(first + width*(i+1), 6) AS low, round(first + width*(j+1), 6) AS auto,
  round(greatest(top, first + width*(j+1) + 1), 6) AS high FROM best JOIN e USING (scan_id)""")
def _(fx):
    out = histogram.otsu_thresholds(histogram.inside_fov(fx.voxels))
    return out.select("scan_id", *[F.round(c, 6).alias(c) for c in ("low", "auto", "high")])


@check("a05_inside_fov", """WITH a AS (SELECT scan_id, z, y, x, hu, min(hu) OVER w AS lo, max(hu) OVER w AS hi FROM voxels WINDOW w AS (PARTITION BY scan_id))
 SELECT scan_id, z, y, x, hu FROM a WHERE hi <= lo + 1 OR hu > lo + 1""")
def _(fx):
    return histogram.inside_fov(fx.voxels)

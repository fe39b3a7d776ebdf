"""Numbering, quality control and canal-health checks."""
from pyspark.sql import functions as F

from suites import check, digest, digest_sql
from suites.pieces import BLOCK, pieces_sql
from suites.tilings import linear_scorer
from voxelspark.operators import canal, crop, instances, measure, tiles
from voxelspark.operators.tiles import KEYS
from voxelspark.plans import flows
from voxelspark.sources import config

UP = (1, 16)


@check("f22_restrict_ids", """WITH m AS (SELECT scan_id, z, y, x FROM jaw_labels WHERE label = 4)
 SELECT scan_id, z, y, x, id FROM tooth_pred p WHERE id BETWEEN 1 AND 16 OR (id BETWEEN 33 AND 35 AND EXISTS (SELECT 1 FROM m
  WHERE m.scan_id = p.scan_id AND (m.z-p.z)*(m.z-p.z) + (m.y-p.y)*(m.y-p.y) + (m.x-p.x)*(m.x-p.x) <= 12.25))""")
def _(fx):
    return instances.restrict_ids(fx.tooth_pred, fx.labels.filter("label = 4"), fx.scans, UP)


_MASK = "label = 3 or (label = 4 and (x < 3 or scan_id % 2 = 0)) or (label = 1 and (z = 15 or (z = 2 and x < 4)))"
_NEAR = " AND ".join(f"greatest(0, c.a{a} - b.h{a}, b.l{a} - c.b_{a}) <= 13/6.0::DOUBLE" for a in "zyx")


@check("c06_clean_arch_mask", "WITH RECURSIVE " + pieces_sql(f"(SELECT * FROM jaw_labels WHERE {_MASK})", "1::INT") + f""",
 cb AS (SELECT scan_id, comp, any_value(size) AS size, min(z) AS az, max(z) + 1 AS b_z, min(y) AS ay, max(y) + 1 AS b_y, min(x0) AS ax, max(x1) + 1 AS b_x FROM piece GROUP BY scan_id, comp),
 cd AS (SELECT c.*, rank, c.size*0.216::DOUBLE >= 3.0 AS large, bool_or(c.size*0.216::DOUBLE >= 3.0) OVER (PARTITION BY c.scan_id) AS any_large,
  count(*) OVER (PARTITION BY c.scan_id) AS k FROM cb c JOIN comps USING (scan_id, comp)),
 reach(scan_id, lz, hz, ly, hy, lx, hx) USING KEY (scan_id) AS (
  SELECT scan_id, min(az), max(b_z), min(ay), max(b_y), min(ax), max(b_x) FROM cd WHERE large OR (rank = 1 AND NOT any_large) GROUP BY scan_id UNION
  SELECT b.scan_id, least(any_value(b.lz), min(c.az)), greatest(any_value(b.hz), max(c.b_z)), least(any_value(b.ly), min(c.ay)), greatest(any_value(b.hy), max(c.b_y)),
   least(any_value(b.lx), min(c.ax)), greatest(any_value(b.hx), max(c.b_x)) FROM reach b JOIN cd c ON c.scan_id = b.scan_id AND {_NEAR}
   AND (c.az < b.lz OR c.b_z > b.hz OR c.ay < b.ly OR c.b_y > b.hy OR c.ax < b.lx OR c.b_x > b.hx) GROUP BY b.scan_id),
 kept AS (SELECT c.scan_id, c.comp FROM cd c JOIN reach b ON b.scan_id = c.scan_id WHERE k = 1 OR large OR (rank = 1 AND NOT any_large) OR ({_NEAR}))
 SELECT scan_id, z, y, unnest(range(x0, x1 + 1)) AS x FROM piece SEMI JOIN kept USING (scan_id, comp)""")
def _(fx):
    return instances.clean_arch_mask(fx.labels.filter(_MASK).select(*KEYS), fx.qc_scans, min_cm3=3.0, gap_mm=13.0, block=BLOCK)


@check("c07_one_instance_per_number", "WITH RECURSIVE " + pieces_sql("(SELECT * FROM tooth_pred WHERE id <= 32)", "id") + """,
 vx AS (SELECT p.scan_id, p.g AS id, z, y, unnest(range(x0, x1 + 1)) AS x, rank FROM piece p JOIN comps USING (scan_id, g, comp)),
 kept AS (SELECT scan_id, z, y, x, id FROM vx WHERE rank = 1 UNION ALL SELECT scan_id, z, y, x, id FROM tooth_pred WHERE id > 32),
 near AS (SELECT o.scan_id, o.z, o.y, o.x, min(k.id) AS id FROM vx o JOIN kept k ON k.scan_id = o.scan_id AND abs(k.z-o.z) + abs(k.y-o.y) + abs(k.x-o.x) = 1
  WHERE o.rank > 1 GROUP BY ALL)
 SELECT * FROM kept UNION ALL SELECT * FROM near""")
def _(fx):
    return instances.one_instance_per_number(fx.tooth_pred, fx.qc_scans, 6.0, BLOCK)


@check("c08_qc_merge")
def _(fx):
    voxels, notes = instances.qc_merge(fx.tooth_pred.filter("id <= 16 or id >= 33"), fx.qc_scans, UP)
    n = voxels.groupBy("scan_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(notes, "scan_id").select("scan_id", "id", "n", F.array_join("notes", "; ").alias("notes"))


@check("c09_small_tooth_notes", """SELECT scan_id, id, concat('tooth ', (id-1)//8*10 + 10 + (id-1)%8 + 1, ' is small: ', printf('%.2f', v), ' cm3, ', printf('%.0f', v/u*100), '% of typical') AS note
 FROM (SELECT scan_id, id, count(*)*0.216::DOUBLE AS v, case (id-1)%8 + 1 when 1 then 15.0::DOUBLE when 2 then 9.0::DOUBLE when 3 then 12.0::DOUBLE else 0.5::DOUBLE end AS u
  FROM tooth_pred WHERE id BETWEEN 1 AND 16 GROUP BY scan_id, id) WHERE v < 0.35::DOUBLE*u""")
def _(fx):
    return instances.small_tooth_notes(fx.tooth_pred, fx.qc_scans, UP, {1: 15.0, 2: 9.0, 3: 12.0})


_SEEDS = "seed AS (SELECT * FROM tooth_pred WHERE (z + 2*y + 3*x) % 5 = 0 OR id = 33), msk AS (SELECT scan_id, z, y, x FROM jaw_labels WHERE label = 3)"
_NUMBERED = f"""{_SEEDS}, pro AS (SELECT scan_id, z, y, x, id FROM seed WHERE id BETWEEN 33 AND 35), teeth AS (SELECT * FROM msk ANTI JOIN pro USING (scan_id, z, y, x)),
 num AS (SELECT * FROM pro UNION ALL SELECT t.scan_id, t.z, t.y, t.x, arg_min(s.id, ((s.z-t.z)*(s.z-t.z) + (s.y-t.y)*(s.y-t.y) + (s.x-t.x)*(s.x-t.x))*1000 + s.id) FROM teeth t
  JOIN seed s ON s.scan_id = t.scan_id AND s.id BETWEEN 1 AND 16 AND (s.z-t.z)*(s.z-t.z) + (s.y-t.y)*(s.y-t.y) + (s.x-t.x)*(s.x-t.x) <= 1 GROUP BY ALL)"""


def _assigned(fx):
    seeds = fx.tooth_pred.filter("(z + 2*y + 3*x) % 5 = 0 or id = 33")
    return instances.assign_numbers(fx.labels.filter("label = 3"), seeds, fx.qc_scans, UP, 6.0)


@check("c15_assign_numbers", f"WITH {_NUMBERED} SELECT * FROM num")
def _(fx):
    return _assigned(fx)


@check("c15_unnumbered", f"""WITH {_NUMBERED} SELECT scan_id, round(count(*) FILTER (id IS NULL)*0.216::DOUBLE, 6) AS unnumbered_cm3
 FROM teeth LEFT JOIN num USING (scan_id, z, y, x) GROUP BY scan_id""")
def _(fx):
    out = instances.unnumbered(fx.labels.filter("label = 3"), _assigned(fx), fx.qc_scans)
    return out.withColumn("unnumbered_cm3", F.round("unnumbered_cm3", 6))


@check("c16_merge_arches", """WITH u AS (SELECT * FROM tooth_pred WHERE id <= 16 OR id = 33), l AS (SELECT scan_id, z + 1 AS z, y, x, id + 16 AS id FROM tooth_pred WHERE id <= 16
   UNION ALL SELECT scan_id, z, y, x, id FROM tooth_pred WHERE id BETWEEN 17 AND 32)
 SELECT scan_id, z, y, x, coalesce(u.id, l.id) AS id FROM u FULL JOIN l USING (scan_id, z, y, x)""")
def _(fx):
    upper = fx.tooth_pred.filter("id <= 16 or id = 33")
    lower = fx.tooth_pred.filter("id <= 16").selectExpr("scan_id", "z + 1 AS z", "y", "x", "cast(id + 16 as short) AS id")
    return instances.merge_arches(upper, lower.unionByName(fx.tooth_pred.filter("id between 17 and 32")))


@check("c16_arches_present", """SELECT s.scan_id, a.label, a.arch, count(l.label)*0.216::DOUBLE AS volume_cm3, count(l.label)*0.216::DOUBLE >= 12 AS used FROM scans s
 CROSS JOIN (VALUES (3, 'upper'), (4, 'lower')) a(label, arch) LEFT JOIN jaw_labels l ON l.scan_id = s.scan_id AND l.label = a.label GROUP BY ALL""")
def _(fx):
    return instances.arches_present(fx.labels, fx.qc_scans, 12.0)


@check("c17_tooth_report", "WITH RECURSIVE " + pieces_sql("tooth_pred", "id") + """, k AS (SELECT scan_id, g AS id, sum(size) AS n, count(*) AS components FROM comps
  WHERE size >= greatest(1, floor(3::DOUBLE/0.216::DOUBLE)) GROUP BY ALL),
 r AS (SELECT *, case when id <= 32 then (id-1)//8*10 + 10 + (id-1)%8 + 1 end AS fdi FROM k)
 SELECT scan_id, coalesce(fdi::VARCHAR, 'implant') AS key, fdi, case when fdi is null then 'implant' else concat('Tooth ', fdi, ' (',
  ['Upper Right','Upper Left','Lower Left','Lower Right'][fdi//10], ' ',
  ['Central Incisor','Lateral Incisor','Canine','First Premolar','Second Premolar','First Molar','Second Molar','Third Molar'][fdi%10], ')') end AS name,
  round_even(n*0.216::DOUBLE, 2) AS volume_cm3, case when fdi is null then components end AS components FROM r""")
def _(fx):
    return instances.tooth_report(fx.tooth_pred, fx.qc_scans, 3.0, BLOCK)


_HEALTH = "WITH RECURSIVE " + """jf AS (SELECT scan_id, nj, (x0 + x1)//2 AS mid, (x1 - x0 + 1)*6 >= 75 AS whole, (y1 - y0 + 1)*6.0::DOUBLE AS span FROM (
  SELECT scan_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS nj FROM jaw_labels WHERE label = 1 GROUP BY scan_id)),
 can AS (SELECT l.*, case when whole and x >= mid then 1 else 0 end AS side FROM jaw_labels l JOIN jf USING (scan_id) WHERE label = 5),
 """ + pieces_sql("can", "side") + """,
 hv AS (SELECT l.scan_id, case when whole and x >= mid then 1 else 0 end AS side, count(*) AS n FROM jaw_labels l JOIN jf USING (scan_id) WHERE label = 1 GROUP BY ALL),
 pc AS (SELECT scan_id, g AS side, count(*) AS comps FROM comps GROUP BY ALL),
 pv AS (SELECT scan_id, side, count(*)*0.216::DOUBLE AS vol, (max(y) - min(y) + 1)*6.0::DOUBLE AS span FROM can GROUP BY ALL),
 sd AS (SELECT h.scan_id, h.side, coalesce(vol, 0) AS vol, coalesce(v.span, 0) AS span, coalesce(comps, 0) AS comps,
  case when h.side = 1 then mid else 0 end AS x0, case when whole and h.side = 0 then mid else 16 end AS x1
  FROM hv h JOIN jf USING (scan_id) LEFT JOIN pc USING (scan_id, side) LEFT JOIN pv v USING (scan_id, side) WHERE NOT whole OR h.n >= 0.2*nj),
 ag AS (SELECT scan_id, count(*) AS n_sides, min(vol) AS vol_min, case when max(vol) > 0 then min(vol)/max(vol) else 0 end AS asym, min(span) AS span_min, max(comps) AS comps_max FROM sd GROUP BY scan_id),
 tot AS (SELECT scan_id, count(*)*0.216::DOUBLE AS volume_cm3 FROM can GROUP BY scan_id),
 hl AS (SELECT scan_id, coalesce(volume_cm3, 0) AS volume_cm3, whole AS whole_jaw, n_sides, vol_min, asym, span_min/jf.span AS span_frac, comps_max
  FROM jf JOIN ag USING (scan_id) LEFT JOIN tot USING (scan_id))"""


@check("c10_canal_health", _HEALTH + """ SELECT scan_id, round(volume_cm3, 6) AS volume_cm3, whole_jaw, n_sides, round(vol_min, 6) AS vol_min, round(asym, 6) AS asym,
 round(span_frac, 6) AS span_frac, comps_max, concat_ws('; ', case when n_sides = 2 and volume_cm3 < 0.45 then printf('volume %.2f cm3', volume_cm3) end,
  case when vol_min < 0.15 then printf('weak side %.2f cm3', vol_min) end, case when n_sides = 2 and asym < 0.45 then printf('asymmetry %.2f', asym) end,
  case when span_frac < 0.3 then printf('course covered %.2f', span_frac) end, case when comps_max > 2 then concat(comps_max, ' pieces on one side') end) AS reasons FROM hl""")
def _(fx):
    out = canal.canal_health(fx.labels, fx.qc_scans, block=BLOCK)
    return out.select("scan_id", *[F.round(c, 6).alias(c) for c in ("volume_cm3", "vol_min", "asym", "span_frac")],
                      "whole_jaw", "n_sides", "comps_max", F.array_join("reasons", "; ").alias("reasons"))


_REDO = """bad AS (SELECT s.*, row_number() OVER (PARTITION BY scan_id ORDER BY side) - 1 AS turn FROM sd s JOIN ag USING (scan_id) WHERE n_sides = 2 AND (s.vol < 0.15 OR s.comps > 2)),
 rd AS (SELECT scan_id, turn, x0, x1 FROM bad UNION ALL SELECT scan_id, 0, NULL, NULL FROM hl WHERE scan_id NOT IN (SELECT scan_id FROM bad))"""


@check("c11_sides_to_redo", _HEALTH + f", {_REDO} SELECT * FROM rd")
def _(fx):
    return canal.sides_to_redo(canal.canal_health(fx.labels, fx.qc_scans, block=BLOCK))


@check("c12_fine_box", "WITH RECURSIVE " + pieces_sql("(SELECT * FROM jaw_labels WHERE label = 1)", "label") + """,
 rd AS (SELECT scan_id, case when scan_id % 3 = 0 then NULL when scan_id % 3 = 1 then 0 else 8 end AS r0, case when scan_id % 3 = 0 then NULL when scan_id % 3 = 1 then 8 else 16 end AS r1 FROM scans),
 vx AS (SELECT p.scan_id, z, y, unnest(range(p.x0, p.x1 + 1)) AS x FROM piece p JOIN comps USING (scan_id, g, comp) WHERE rank = 1),
 bb AS (SELECT scan_id, r0, r1, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM vx JOIN rd USING (scan_id) WHERE r0 IS NULL OR (x >= r0 AND x < r1) GROUP BY ALL),
 ix AS (SELECT scan_id, r0 AS x0, r1 AS x1, greatest(floor(lx - 1.25::DOUBLE + 0.5), 0) AS ax, least(ceil(hx + 1.25::DOUBLE + 0.5), 16) AS bx, greatest(floor(ly - 1.25::DOUBLE + 0.5), 0) AS ay,
  least(ceil(hy + 1.25::DOUBLE + 0.5), 16) AS "by", greatest(floor(lz - 1.25::DOUBLE + 0.5), 0) AS az, least(ceil(hz + 1.25::DOUBLE + 0.5), 16) AS bz FROM bb)
 SELECT *, ((bx-ax)*24*("by"-ay)*24*(bz-az)*24)::BIGINT AS fine_voxels, true AS fits FROM ix""")
def _(fx):
    k = F.col("scan_id") % 3
    redo = fx.scans.select("scan_id", F.when(k == 1, 0).when(k == 2, 8).alias("x0"), F.when(k == 1, 8).when(k == 2, 16).alias("x1"))
    return canal.fine_box(fx.labels, fx.qc_scans, fx.qc_scans, redo, margin_mm=7.5, block=BLOCK)


@check("c13_merge_second_pass", """WITH nw AS (SELECT DISTINCT scan_id, z + case when scan_id % 2 = 0 then 1 else 0 end AS z, y, x FROM jaw_labels WHERE label = 5 AND (scan_id % 3 <> 0 OR y < 9)),
 b2 AS (SELECT scan_id, z, y, x, o, case when one = 1 and (o is null or o in (1, 5)) then 5 when o = 5 and looked then null else o end AS m FROM (
  SELECT scan_id, z, y, x, l.label AS o, n.one, scan_id % 5 <> 1 OR x < 8 AS looked FROM jaw_labels l FULL JOIN (SELECT *, 1 AS one FROM nw) n USING (scan_id, z, y, x))),
 v AS (SELECT scan_id, count(*) FILTER (m = 5) >= count(*) FILTER (o = 5) AS better FROM b2 GROUP BY scan_id)
 SELECT scan_id, z, y, x, label FROM (SELECT scan_id, z, y, x, case when better then m else o end AS label FROM b2 JOIN v USING (scan_id)) WHERE label IS NOT NULL""")
def _(fx):
    new = fx.labels.filter("label = 5 and (scan_id % 3 <> 0 or y < 9)").selectExpr(
        "scan_id", "z + case when scan_id % 2 = 0 then 1 else 0 end AS z", "y", "x")
    part = F.when(F.col("scan_id") % 5 == 1, 8).otherwise(16)
    covered = fx.scans.select("scan_id", *[F.lit(0).alias(f"a{a}") for a in "zyx"], F.lit(16).alias("bz"),
                              F.lit(16).alias("by"), part.alias("bx"))
    return canal.merge_second_pass(fx.labels, new, fx.qc_scans, covered, BLOCK)


@check("a11_calibrate_triggers", _HEALTH + """, ft AS (SELECT 'vol_min' AS feature, vol_min AS v, true AS low_is_bad FROM hl UNION ALL SELECT 'span_frac', span_frac, true FROM hl
  UNION ALL SELECT 'comps_max', comps_max, false FROM hl)
 SELECT feature, low_is_bad, round(case when low_is_bad then lo else hi end, 6) AS threshold FROM (SELECT feature, low_is_bad,
  quantile_cont(v::DOUBLE, 0.03) AS lo, quantile_cont(v::DOUBLE, 0.97) AS hi FROM ft GROUP BY ALL)""")
def _(fx):
    h = canal.canal_health(fx.labels, fx.qc_scans, block=BLOCK)
    feats = h.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                                                  F.lit(low).alias("low_is_bad"))
                                         for n, low in (("vol_min", True), ("span_frac", True), ("comps_max", False))])).alias("f"))
    return measure.calibrate_triggers(feats.select("f.*")).withColumn("threshold", F.round("threshold", 6))


def canal_scorer(box):
    """Three votes per voxel from its normalised intensity: air, bone, canal."""
    import numpy as np
    out = np.zeros((6, *box.shape), np.float32)
    out[1] = box
    out[5] = 0.4 - np.abs(box - 0.4)
    return out


@check("c14_refine")
def _(fx):
    qc = fx.qc_scans
    grid = qc.withColumns({"spacing": F.array(*[F.lit(6.0)] * 3)})
    out = flows.refine_canal(fx.labels, grid, canal_scorer, (8, 8, 8), 6, source=(fx.voxels, qc), spacing=6.0,
                             margin_mm=12.0, block=BLOCK)
    return digest(out, F.col("label").cast("long"))


@check("c14_refine_match")
def _(fx):
    curve = ([i / 8 for i in range(9)], [-1000.0 + 300 * i for i in range(9)])
    out = flows.refine_canal(fx.labels, fx.qc_scans, canal_scorer, (8, 8, 8), 6, mode="match", voxels=fx.voxels,
                             curve=curve, margin=2, block=BLOCK)
    return digest(out, F.col("label").cast("long"))


def tooth_scorer(box):
    """Votes for four tooth numbers by position along the crop."""
    import numpy as np
    out = np.zeros((36, *box.shape), np.float32)
    at = np.arange(box.shape[2])
    for i in range(1, 5):
        out[i] = 3.0 - np.abs(at - 2.0 * i)
        out[i + 16] = 2.5 - np.abs(at - 2.0 * i)
    return out


@check("flow_separate_teeth")
def _(fx):
    _, report = flows.separate_teeth(fx.voxels, fx.labels, fx.qc_scans, tooth_scorer, (4, 8, 8), radius_mm=6.0, block=BLOCK)
    return report.withColumn("notes", F.array_join("notes", "; "))


@check("flow_segment_report")
def _(fx):
    _, labels, grid = flows.segment_blocks(fx.voxels, fx.scans, linear_scorer, (16, 16, 16), 10)
    return flows.class_report(labels, grid)


def band_scorer(box):
    """Ten bands of normalised intensity, without ties."""
    import numpy as np
    return np.stack([0.06 * c - np.abs(box + 2.0 - c / 2) for c in range(10)]).astype(np.float32)


_CONFIGS = ("case when k % 11 = 3 then null when k % 2 = 0 then '{\"tile\": [12, 8, 16], \"tile_divisor\": [2, 2, 4], \"overlap\": 0.5, \"normalization\": "
            "{\"clip\": [-1000, 3492], \"mean\": 500, \"std\": 512}}' else '{\"tile\": [4, 12, 9], \"tile_divisor\": [1, 3, 3], \"overlap\": 0.25, "
            "\"normalization\": {\"clip\": [-500, 1000], \"mean\": 100, \"std\": 256}}' end")
_DEEP = "case k % 3 when 0 then 16 when 1 then 10 else 3 end"


@check("flow_label_configured", f"""WITH s AS (SELECT s_suppkey AS scan_id, s_suppkey AS k, {_DEEP} AS nz, s_suppkey % 2 = 0 AS even FROM supplier WHERE s_suppkey % 11 <> 3),
 v AS (SELECT v.scan_id, z, y, x, case when even then (least(greatest(hu, -1000), 3492) - 500)/512.0::DOUBLE else (least(greatest(hu, -500), 1000) - 100)/256.0::DOUBLE end AS v
  FROM voxels v JOIN s USING (scan_id) WHERE z < nz),
 b AS (SELECT scan_id, z, y, x, list_transform(range(10), lambda c: 0.06::DOUBLE*c - abs(v + 2 - c/2.0::DOUBLE)) AS l FROM v),
 r AS (SELECT scan_id, z, y, x, list_position(l, list_max(l)) - 1 AS label FROM b),
 d AS ({digest_sql("r WHERE label > 0", "label")}),
 t AS (SELECT scan_id, case when even then greatest(4, least(12, greatest(nz, 4)) // 2 * 2) else greatest(2, least(4, greatest(nz, 2))) end AS tz,
  case when even then 8 else 12 end AS ty, case when even then 16 else 9 end AS tx FROM s)
 SELECT d.*, tz::INT AS tz, ty::INT AS ty, tx::INT AS tx FROM d JOIN t USING (scan_id)""")
def _(fx):
    k = F.col("scan_id")
    scans = fx.scans.withColumn("nz", F.expr(_DEEP.replace("k %", "scan_id %")))
    voxels = fx.voxels.join(scans.select("scan_id", "nz"), "scan_id").filter("z < nz").drop("nz")
    text = F.expr(_CONFIGS.replace("k %", "scan_id %"))
    cand = scans.select(k.alias("run_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("priority"), text.alias("config"))
    cand = cand.select("run_id", "priority", F.format_string("cfg%d.json", "priority").alias("path"), "config",
                       (F.col("config").isNotNull() & (F.col("priority") > F.col("run_id") % 2)).alias("present"))
    chosen = config.load_config(cand).withColumnRenamed("run_id", "scan_id")
    labels, fitted = flows.label_configured(voxels, scans, chosen, band_scorer, 10, block=5)
    return digest(labels, F.col("label").cast("long")).join(fitted.select("scan_id", "tz", "ty", "tx"), "scan_id")

"""Volumes, boxes, agreement, calibration, sampling, naming."""
from pyspark.sql import functions as F

from suites import check
from voxelspark.functions import geometry as G
from voxelspark.functions import intensity as I
from voxelspark.functions import naming
from voxelspark.operators import measure

CLASS_SQL = "(VALUES " + ", ".join(f"({i}, '{k}', '{n}')" for i, k, n, _ in naming.CLASSES) + ") c(class_id, key, name)"


def _volumes_sql(labels, scans, vox):
    return f"""SELECT s.scan_id, c.class_id, c.key, c.name, count(l.label) AS voxels,
 round_even(count(l.label) * ({vox}), 2) AS volume_cm3
 FROM {scans} s CROSS JOIN {CLASS_SQL} LEFT JOIN {labels} l ON l.scan_id = s.scan_id AND l.label = c.class_id
 GROUP BY ALL"""


@check("a06_class_volumes", _volumes_sql("jaw_labels", "scans", "0.216::DOUBLE"))
def _(fx):
    return measure.class_volumes(fx.labels, fx.qc_scans)


@check("flow_class_volumes_of_valid_scans", """WITH ok AS (SELECT * FROM scans WHERE sx >= 0.04 AND sx <= 1.2),
 lab AS (SELECT scan_id, case when v > 0.5 then 1 when v > -0.8 then 2 else 0 end AS label FROM (SELECT v.scan_id,
  (least(greatest(hu::DOUBLE, -1000), 3492) - 656.9095458984375::DOUBLE) / 1074.9185791015625::DOUBLE AS v FROM voxels v JOIN ok USING (scan_id)))
 """ + _volumes_sql("lab", "ok", "s.sx*s.sy*s.sz/1000.0::DOUBLE").replace("GROUP BY ALL", "GROUP BY s.scan_id, c.class_id, c.key, c.name, s.sx, s.sy, s.sz"))
def _(fx):
    from voxelspark.plans.flows import class_volumes_of_valid_scans
    return class_volumes_of_valid_scans(fx.voxels, fx.scans)


@check("a07_bounding_box", """SELECT scan_id, label, count(*) AS voxels,
 greatest(min(z)-2, 0) AS az, least(max(z)+3, 16) AS bz, greatest(min(y)-2, 0) AS ay, least(max(y)+3, 16) AS "by",
 greatest(min(x)-2, 0) AS ax, least(max(x)+3, 16) AS bx FROM jaw_labels GROUP BY ALL""")
def _(fx):
    return measure.bounding_box(fx.labels, fx.scans, margin=2)


_DICE = """n AS (SELECT scan_id, class_id, count(*) FILTER (t) AS nt, count(*) FILTER (o) AS no_, count(*) FILTER (q) AS nq,
  count(*) FILTER (t AND o) AS n_to, count(*) FILTER (t AND q) AS n_tq, count(*) FILTER (o AND q) AS n_oq FROM (
  SELECT scan_id, z, y, x, label AS class_id, bool_or(src = 1) AS t, bool_or(src = 2) AS o, bool_or(src = 3) AS q FROM (
   SELECT *, 1 AS src FROM (SELECT scan_id, z, y, x, label FROM truth) UNION ALL SELECT *, 2 FROM (SELECT scan_id, z, y, x, label FROM ours)
   UNION ALL SELECT *, 3 FROM (SELECT scan_id, z, y, x, label FROM other)) GROUP BY ALL) GROUP BY ALL),
 d AS (SELECT scan_id, class_id, case when nt > 0 then 2.0::DOUBLE*n_to/(nt+no_) end AS ours, case when nt > 0 then 2.0::DOUBLE*n_tq/(nt+nq) end AS other,
  case when no_ + nq = 0 then 'nan'::DOUBLE else 2.0::DOUBLE*n_oq/(no_+nq) end AS agreement FROM n WHERE nt > 0 OR no_ > 0)"""


@check("a08_dice", f"WITH {_DICE} SELECT scan_id, class_id, round(ours, 6) AS ours, round(other, 6) AS other, round(agreement, 6) AS agreement FROM d")
def _(fx):
    out = measure.dice(fx.truth, fx.ours, fx.other)
    return out.select("scan_id", "class_id", *[F.round(c, 6).alias(c) for c in ("ours", "other", "agreement")])


@check("a09_dice_summary", f"""WITH {_DICE}, m AS (SELECT class_id, count(ours) AS n, round_even(avg(ours), 4) AS ours, round_even(avg(other), 4) AS other,
  round_even(avg(agreement), 4) AS agreement FROM d GROUP BY class_id HAVING count(ours) > 0),
 a AS (SELECT * FROM m UNION ALL SELECT 0, sum(n)::BIGINT, round_even(avg(ours), 4), round_even(avg(other), 4), round_even(avg(agreement), 4) FROM m WHERE NOT isnan(ours))
 SELECT *, round_even(ours - other, 4) AS difference FROM a""")
def _(fx):
    return measure.dice_summary(measure.dice(fx.truth, fx.ours, fx.other))


@check("a10_voxel_agreement", """WITH u AS (SELECT scan_id, z, y, x, a.label AS a, b.label AS b FROM ours a FULL JOIN other b USING (scan_id, z, y, x)),
 n AS (SELECT scan_id, count(*) AS seen, count(*) FILTER (a = b) AS same FROM u GROUP BY scan_id)
 SELECT scan_id, 4096 - coalesce(seen, 0) + coalesce(same, 0) AS equal, 4096 AS total, round((4096 - coalesce(seen, 0) + coalesce(same, 0))/4096.0::DOUBLE, 6) AS share
 FROM scans LEFT JOIN n USING (scan_id)""")
def _(fx):
    out = measure.voxel_agreement(fx.ours, fx.other, fx.scans)
    return out.withColumn("share", F.round("share", 6))


@check("a12_typical_volumes", """SELECT tooth_type, round(quantile_cont(v, 0.5), 6) AS median_cm3 FROM (SELECT (id-1)%8 + 1 AS tooth_type, count(*)*0.216::DOUBLE AS v
 FROM tooth_pred WHERE id <= 32 GROUP BY scan_id, id) GROUP BY tooth_type""")
def _(fx):
    out = measure.typical_volumes(fx.tooth_pred, fx.qc_scans)
    return out.withColumn("median_cm3", F.round("median_cm3", 6))


@check("a13_stratified_sample", """SELECT prefix, rank, scan_id FROM (SELECT concat('src', s_nationkey % 4) AS prefix, s_suppkey AS scan_id,
 row_number() OVER (PARTITION BY s_nationkey % 4 ORDER BY (s_suppkey * 7919 + 31) % 10007, s_suppkey) AS rank FROM supplier) WHERE rank <= 10""")
def _(fx):
    src = fx.table("supplier").select(F.col("s_suppkey").alias("scan_id"), "s_nationkey")
    out = measure.stratified_sample(src, F.concat(F.lit("src"), (F.col("s_nationkey") % 4).cast("string")),
                                    order=(F.col("scan_id") * 7919 + 31) % 10007)
    return out.select("prefix", "rank", "scan_id")


@check("a14_tooth_number_accuracy", """WITH t AS (SELECT scan_id, z, y, x, id AS t FROM tooth_truth), p AS (SELECT scan_id, z, y, x, id AS p FROM tooth_pred WHERE id <= 32),
 n AS (SELECT scan_id, t, p, count(*) AS n FROM t FULL JOIN p USING (scan_id, z, y, x) GROUP BY ALL),
 b AS (SELECT DISTINCT ON (scan_id, t) scan_id, t, p FROM n WHERE t IS NOT NULL ORDER BY scan_id, t, (p IS NULL), n DESC, p),
 e AS (SELECT scan_id, count(*) FILTER (NOT met) AS extra FROM (SELECT scan_id, p, bool_or(t IS NOT NULL) AS met FROM n WHERE p IS NOT NULL GROUP BY ALL) GROUP BY scan_id)
 SELECT scan_id, count(*) AS teeth, count(*) FILTER (p = t) AS correct, count(*) FILTER (p <> t) AS wrong, count(*) FILTER (p IS NULL) AS missed, any_value(extra) AS extra
 FROM b JOIN e USING (scan_id) GROUP BY scan_id""")
def _(fx):
    return measure.tooth_number_accuracy(fx.tooth_truth, fx.tooth_pred)


_NAMES = ["' Mandible '", "'5'", "'all'", "'Upper_Teeth'", "'0'", "''", "'pharynx'"]


@check("f05_resolve_classes", f"""WITH k AS (SELECT * FROM {CLASS_SQL} UNION ALL SELECT class_id, class_id::VARCHAR, '' FROM {CLASS_SQL}),
 r AS (SELECT p_partkey AS request_id, case when p_partkey % 11 = 0 then []::VARCHAR[] else
  [case p_partkey % 7 {' '.join(f'when {i} then {n}' for i, n in enumerate(_NAMES))} end, case p_size % 7 {' '.join(f'when {i} then {n}' for i, n in enumerate(_NAMES))} end] end AS names FROM part),
 u AS (SELECT request_id, unnest(names) AS n, unnest(range(len(names))) AS pos FROM r),
 m AS (SELECT request_id, pos, lower(trim(n)) AS n, class_id FROM u LEFT JOIN k ON k.key = lower(trim(u.n))),
 s AS (SELECT request_id, min(pos) FILTER (n = 'all') AS whole, min(pos) FILTER (n <> 'all' AND class_id IS NULL) AS bad FROM m GROUP BY request_id)
 SELECT r.request_id, case when len(names) = 0 or (whole is not null and (bad is null or whole < bad)) then '1,2,3,4,5,6,7,8,9'
  when bad is null then (SELECT string_agg(class_id::VARCHAR, ',' ORDER BY pos) FROM m WHERE m.request_id = r.request_id) end AS class_ids,
  case when whole is not null and whole < bad then null when bad is not null then (SELECT n FROM m WHERE m.request_id = r.request_id AND m.pos = s.bad) end AS unknown
 FROM r LEFT JOIN s USING (request_id)""")
def _(fx):
    def pick(c):
        e = F
        out = None
        for i, n in enumerate(_NAMES):
            v = F.lit(n.strip("'"))
            out = e.when(c % 7 == i, v) if out is None else out.when(c % 7 == i, v)
        return out
    req = fx.table("part").select(F.col("p_partkey").alias("request_id"), F.when(
        F.col("p_partkey") % 11 == 0, F.array().cast("array<string>")).otherwise(
        F.array(pick(F.col("p_partkey")), pick(F.col("p_size")))).alias("names"))
    out = naming.resolve_classes(req)
    return out.select("request_id", F.array_join("class_ids", ",").alias("class_ids"), "unknown")


@check("f15_tooth_names", """SELECT p_partkey, (t // 8 + 1)*10 + t % 8 + 1 AS fdi, concat('Tooth ', (t // 8 + 1)*10 + t % 8 + 1, ' (',
 ['Upper Right','Upper Left','Lower Left','Lower Right'][t // 8 + 1], ' ',
 ['Central Incisor','Lateral Incisor','Canine','First Premolar','Second Premolar','First Molar','Second Molar','Third Molar'][t % 8 + 1], ')') AS name
 FROM (SELECT p_partkey, p_partkey % 32 AS t FROM part)""")
def _(fx):
    t = F.col("p_partkey") % 32 + 1
    return fx.table("part").select("p_partkey", naming.fdi_number(t).alias("fdi"), naming.tooth_name(t).alias("name"))


@check("f17_scan_label", r"""WITH m AS (SELECT root, path, split_part(path, '/', -1) AS base, case when contains(path, '/') then split_part(path, '/', -2) else '' end AS dir FROM manifest),
 b AS (SELECT *, regexp_replace(base, '\.(nii\.gz|zip|mha|mhd|nrrd|nii|dcm)$', '', 'i') AS name FROM m)
 SELECT root, path, case when name = '' then 'scan' when lower(name) IN ('ct','dicom','data','dcm','cbct','kt','vol_1','vol_2','vol_3','scan','images') AND dir <> ''
  then concat(dir, '/', name) else name end AS label FROM b""")
def _(fx):
    return fx.manifest.select("root", "path", naming.scan_label(F.col("path")).alias("label"))


@check("f18_classify_failure", """SELECT run_id, seq, case when lower(line) LIKE '%out of memory%' then 'out_of_memory'
 when contains(lower(line), '887a0005') or contains(lower(line), 'device removed') then 'device_lost' else 'other' end AS kind FROM run_log""")
def _(fx):
    return fx.run_log.select("run_id", "seq", naming.failure_kind(F.col("line")).alias("kind"))

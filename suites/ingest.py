"""Manifest, series, volume table, report, cache and configuration checks."""
from pyspark.sql import functions as F

from suites import check, digest, digest_sql
from voxelspark.operators import resample
from voxelspark.session import cut_lineage, shared_folder
from voxelspark.functions import geometry
from voxelspark.operators import crop
from voxelspark.sources import config, manifest, preview, reports, volumes


def _folder(fx, name):
    import uuid
    return f"{shared_folder(fx.spark)}/voxelspark-{name}-{uuid.uuid4().hex}"


_EXTS = r"\.(dcm|mha|mhd|nrrd|nhdr|nii|nii\.gz|img|hdr|vtk|gipl|mnc|mrc|rec|spr|h5|tif|tiff)$"


@check("s01_scan_manifest", rf"""SELECT root, path, case when regexp_matches(lower(path), '{_EXTS}') then 'volume'
 when lower(path) LIKE '%.zip' then 'archive' else 'other' end AS kind FROM manifest""")
def _(fx):
    return fx.manifest.withColumn("kind", manifest.file_kind(F.col("path")))


_SERIES = """ser AS (SELECT root, dir, series_uid, slices FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY slices DESC, dir, series_uid) AS rn
  FROM (SELECT root, dir, series_uid, count(*) AS slices FROM slices GROUP BY ALL)) WHERE rn = 1)"""


@check("s02_select_series", f"WITH {_SERIES} SELECT * FROM ser")
def _(fx):
    return manifest.select_series(fx.slices)


@check("s03_resolve_input", rf"""WITH {_SERIES}, fl AS (SELECT root, case when root % 5 = 0 and not lower(path) LIKE '%.zip' then concat(path, '.txt') else path end AS path FROM manifest),
 v AS (SELECT root, min(path) FILTER (regexp_matches(lower(path), '{_EXTS}')) AS vol, count(*) FILTER (lower(path) LIKE '%.zip' AND NOT contains(path, '/')) AS nz,
  min(path) FILTER (lower(path) LIKE '%.zip' AND NOT contains(path, '/')) AS zip FROM fl GROUP BY root)
 SELECT root, case when dir is not null then 'series' when vol is not null then 'volume' when nz = 1 then 'archive' else 'error' end AS how,
  case when dir is not null then dir when vol is not null then vol when nz = 1 then zip else 'no DICOM series and no volume file' end AS path
 FROM v FULL JOIN (SELECT case when root % 3 = 0 then root else -root end AS root, dir FROM ser) USING (root)""")
def _(fx):
    other = (F.col("root") % 5 == 0) & ~F.lower("path").endswith(".zip")      # neither volume nor archive
    files = fx.manifest.withColumn("path", F.when(other, F.concat("path", F.lit(".txt"))).otherwise(F.col("path")))
    series = manifest.select_series(fx.slices).withColumn("root", F.expr("if(root % 3 = 0, root, -root)"))
    return manifest.resolve_input(files, series)


_FOLDER = "case {k} % 5 when 0 then '' when 1 then 'A' when 2 then 'N/O' when 3 then 'R' else 'none' end"


@check("s04_promote_single_slice", f"""WITH sz AS (SELECT root, concat(dir, '/', left(series_uid, 1)) AS dir, dir AS up, series_uid, count(*) AS n FROM slices GROUP BY ALL),
 ab AS (SELECT root, '' AS folder, n FROM sz UNION ALL SELECT root, up, n FROM sz UNION ALL SELECT root, dir, n FROM sz),
 best AS (SELECT root, folder, max(n) AS n FROM ab GROUP BY ALL)
 SELECT volume_id, o.root, o.folder, depth, case when depth <> 1 then 'volume' when coalesce(n, 0) > 1 then 'series' else 'error' end AS status,
 case when depth <> 1 then depth when coalesce(n, 0) > 1 then n end AS slices
 FROM (SELECT o_orderkey AS volume_id, o_custkey AS root, {_FOLDER.format(k='o_custkey')} AS folder, case when o_orderkey % 4 = 0 then 1 else 40 + o_custkey % 7 end AS depth FROM orders) o
 LEFT JOIN best USING (root, folder)""")
def _(fx):
    vol = fx.table("orders").selectExpr("o_orderkey AS volume_id", "o_custkey AS root", _FOLDER.format(k="o_custkey") + " AS folder",
                                        "case when o_orderkey % 4 = 0 then 1 else 40 + o_custkey % 7 end AS depth")
    nested = fx.slices.withColumn("dir", F.expr("concat(dir, '/', left(series_uid, 1))"))
    return manifest.promote_single_slice(vol, manifest.series_sizes(nested))


@check("s05_drop_time_axis", """SELECT root, instance, series_uid, case when frames = 1 then 'ok' else 'rejected' end AS status,
 case when frames <> 1 then concat('a scan with ', frames, ' time frames is not supported') end AS reason FROM slices""")
def _(fx):
    return manifest.drop_time_axis(fx.slices).select("root", "instance", "series_uid", "status", "reason")


@check("s06_read_volumes", digest_sql("(SELECT * FROM jaw_labels WHERE z >= 3 AND z < 11)", "label"))
def _(fx):
    path = _folder(fx, "labels")
    volumes.write_volumes(fx.labels, path, buckets=4)
    return digest(volumes.read_volumes(fx.spark, path, z_range=(3, 11)), F.col("label").cast("long"))


@check("s07_write_labels", digest_sql("(SELECT scan_id, z, y, x + 3 AS x, label FROM jaw_labels WHERE x + 3 < 20)", "label"))
def _(fx):
    path = _folder(fx, "labels")
    shifted = fx.qc_scans.withColumn("origin", F.expr("transform(origin, (v, i) -> v + if(i = 0, 18D, 0D))"))
    full = fx.qc_scans.withColumn("nx", F.lit(20))
    volumes.write_labels(fx.labels, shifted, full, path)
    return digest(volumes.read_volumes(fx.spark, path), F.col("label").cast("long"))


@check("s07_any_orientation", "SELECT scan_id, z, y, x, label FROM jaw_labels")
def _(fx):
    """Labels found on the turned scan, written back on scans of every kind of direction."""
    kinds = F.expr("""case scan_id % 4 when 0 then array(1D,0D,0D,0D,1D,0D,0D,0D,1D) when 1 then array(-1D,0D,0D,0D,-1D,0D,0D,0D,1D)
        when 2 then array(0D,1D,0D,0D,0D,-1D,1D,0D,0D) else array(0.8D,-0.6D,0D,0.6D,0.8D,0D,0D,0D,1D) end""")
    source = fx.scans.withColumn("direction", kinds)
    path = _folder(fx, "labels")
    volumes.write_labels(crop.orient_lps(fx.labels, source), geometry.orient_lps_headers(source), source, path)
    return volumes.read_volumes(fx.spark, path).select("scan_id", "z", "y", "x", "label")


def _reports(fx):
    """Run reports with nested maps, from the supplier table."""
    k = F.col("s_suppkey")
    surface = lambda v, c, t, s: F.struct(v.cast("double").alias("volume_cm3"), c.cast("long").alias("components"),
                                          t.cast("long").alias("triangles"), s.alias("stl"))
    tooth = lambda f, v, s: F.struct(F.lit(f).alias("fdi"), F.lit(f"Tooth {f}").alias("name"), v.alias("volume_cm3"),
                                     F.lit(500).cast("long").alias("triangles"), s.alias("stl"))
    tile = F.array(F.lit(160), F.lit(320), F.lit(320))
    return fx.table("supplier").select(
        k.alias("run_id"), F.col("s_name").alias("input"), F.when(k % 4 != 0, tile).otherwise(F.array(F.lit(128), F.lit(256), F.lit(256))).alias("tile"),
        tile.alias("requested_tile"), F.when(k % 6 == 0, "CPU").otherwise("GPU (CUDA)").alias("device"),
        F.create_map(F.lit("mandible"), surface(k * 0.5, k % 3, k * 100, F.lit("01_mandible.stl")),
                     F.lit("mandibular_canal"), surface(k * 0.25, F.lit(2), k * 10, F.when(k % 4 != 0, "05_canal.stl"))).alias("classes"),
        F.struct(F.create_map(F.lit("36"), tooth(36, k * 0.125, F.lit("teeth/tooth_36.stl")),
                              F.lit("11"), tooth(11, k * 0.0625, F.when(k % 5 != 0, "teeth/tooth_11.stl"))).alias("teeth"),
                 F.when(k % 3 == 0, F.create_map(F.lit("implant_crown"), surface(k * 0.03125, k % 4, k, F.lit("teeth/implant_crown.stl")))).alias("prosthesis"),
                 F.lit(20.5).alias("seconds")).alias("teeth"),
        ((k % 40) / 16.0).alias("full_tile_seconds"), F.when(k % 9 == 0, "does not fit").alias("full_tile_error"),
        (k % 400 + 0.5).alias("seconds"))


def _written(fx):
    path = _folder(fx, "reports")
    reports.write_reports(_reports(fx), path)
    return reports.read_reports(fx.spark, path)


_ITEMS = """it AS (SELECT s_suppkey AS run_id, 'class' AS kind, 'mandible' AS key, NULL::INT AS fdi, NULL AS name, NULL AS place, s_suppkey*0.5 AS volume_cm3, s_suppkey*100 AS triangles, '01_mandible.stl' AS stl FROM supplier
 UNION ALL SELECT s_suppkey, 'class', 'mandibular_canal', NULL, NULL, NULL, s_suppkey*0.25, s_suppkey*10, '05_canal.stl' FROM supplier WHERE s_suppkey % 4 <> 0
 UNION ALL SELECT s_suppkey, 'tooth', '36', 36, 'Tooth 36', 'lower', s_suppkey*0.125, 500, 'teeth/tooth_36.stl' FROM supplier
 UNION ALL SELECT s_suppkey, 'tooth', '11', 11, 'Tooth 11', 'upper', s_suppkey*0.0625, 500, 'teeth/tooth_11.stl' FROM supplier WHERE s_suppkey % 5 <> 0
 UNION ALL SELECT s_suppkey, 'prosthesis', 'implant_crown', NULL, 'Implant Crown', NULL, s_suppkey*0.03125, s_suppkey, 'teeth/implant_crown.stl' FROM supplier WHERE s_suppkey % 3 = 0)"""


@check("s08_write_report", "SELECT s_suppkey AS run_id, s_name AS input, case when s_suppkey % 6 = 0 then 'CPU' else 'GPU (CUDA)' end AS device, 2 AS n_classes, (s_suppkey % 400 + 0.5)::DOUBLE AS seconds FROM supplier")
def _(fx):
    return _written(fx).select("run_id", "input", "device", F.size("classes").alias("n_classes"), "seconds")


@check("s09_read_reports", f"WITH {_ITEMS} SELECT run_id, kind, key, fdi, name, place, volume_cm3::DOUBLE AS volume_cm3, triangles, stl, (run_id * 7 + length(stl)) % 150 < 100 AS empty FROM it")
def _(fx):
    r = _written(fx)
    named = reports.report_items(r).select("run_id", "stl")
    files = named.select("run_id", "stl", ((F.col("run_id") * 7 + F.length("stl")) % 150).alias("length"))
    return reports.report_items(r, files)


@check("s10_preview_cache", """WITH t AS (SELECT scan_id, (scan_id%50 - 500)::DOUBLE AS low, (300 + scan_id%20)::DOUBLE AS auto, (1400 + scan_id%30)::DOUBLE AS high FROM scans),
 m AS (SELECT scan_id, z, y, x, v FROM (SELECT scan_id, z, y, x, round_even(hu*0.37::DOUBLE, 0)::INT AS v FROM voxels) JOIN t USING (scan_id) WHERE v > auto + (high - auto)*(55.0::DOUBLE - 50)/50)
 """ + digest_sql("m", "v"))
def _(fx):
    path, k = _folder(fx, "preview"), F.col("scan_id")
    grid = fx.voxels.withColumn("hu", F.col("hu").cast("double") * 0.37)
    levels = fx.scans.select("scan_id", (k % 50 - 500).cast("double").alias("low"), (k % 20 + 300).cast("double").alias("auto"),
                             (k % 30 + 1400).cast("double").alias("high"))
    preview.save_preview(grid, levels, path)
    return digest(preview.preview_mask(fx.spark, path, 55.0), F.col("hu").cast("long"))


@check("flow_preview")
def _(fx):
    from voxelspark.plans import flows
    path = _folder(fx, "preview")
    grid, levels = flows.preview_grid(fx.voxels, fx.scans)
    preview.save_preview(grid, levels, path)
    return digest(preview.preview_mask(fx.spark, path, 50.0), F.col("hu").cast("long"))


@check("s11_load_config", """WITH c AS (SELECT p_partkey % 97 AS run_id, p_size * 100000 + p_partkey AS priority, concat('cfg', p_partkey, '.json') AS path,
  p_partkey % 3 = 0 AND p_partkey % 97 <> 5 AS present, p_brand AS config FROM part)
 SELECT run_id, arg_min(path, priority) FILTER (present) AS path, arg_min(config, priority) FILTER (present) AS config,
 case when count(*) FILTER (present) = 0 then 'no configuration with the preprocessing parameters found' end AS error FROM c GROUP BY run_id""")
def _(fx):
    p = F.col("p_partkey")
    cand = fx.table("part").select((p % 97).alias("run_id"), (F.col("p_size") * 100000 + p).alias("priority"),
                                   F.concat(F.lit("cfg"), p.cast("string"), F.lit(".json")).alias("path"),
                                   ((p % 3 == 0) & (p % 97 != 5)).alias("present"), F.col("p_brand").alias("config"))
    return config.load_config(cand)


_AUDIT = """fl AS (SELECT source AS archive, doc_id::VARCHAR AS name, sha256(text) AS actual FROM documents WHERE doc_id % 50 <> 1),
 ex AS (SELECT source AS archive, doc_id::VARCHAR AS name, case when doc_id % 50 = 0 and length(source) = 5 then sha256(concat(text, '!')) else sha256(text) end AS expected FROM documents WHERE doc_id % 50 <> 2),
 st AS (SELECT archive, name, case when expected is null then 'extra' when actual is null then 'missing' when expected <> actual then 'mismatch' else 'ok' end AS status FROM ex FULL JOIN fl USING (archive, name))"""


def _audit(fx):
    d = fx.table("documents")
    files = d.filter("doc_id % 50 <> 1").select(F.col("source").alias("archive"), F.col("doc_id").cast("string").alias("name"),
                                                F.col("text").cast("binary").alias("content"))
    changed = (F.col("doc_id") % 50 == 0) & (F.length("source") == 5)
    text = F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    want = d.filter("doc_id % 50 <> 2").select(
        F.col("source").alias("archive"), F.col("doc_id").cast("string").alias("name"), F.sha2(text, 256).alias("expected"))
    return config.checksum_audit(files, want)


@check("s12_checksum_audit", f"WITH {_AUDIT} SELECT * FROM st")
def _(fx):
    return _audit(fx)[0]


@check("s12_checksum_verdict", f"""WITH {_AUDIT} SELECT archive, bool_and(status NOT IN ('missing', 'mismatch')) AS accepted, count(*) FILTER (status = 'ok') AS ok,
 count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'mismatch') AS mismatch FROM st GROUP BY archive""")
def _(fx):
    return _audit(fx)[1]


@check("s13_pseudonymise_paths", r"""WITH m AS (SELECT DISTINCT root, path FROM manifest), f AS (SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY path) AS n,
  case when contains(path, '/') then split_part(path, '/', 1) end AS dir, split_part(path, '/', -1) AS base FROM m),
 d AS (SELECT root, dir, row_number() OVER (PARTITION BY root ORDER BY min(path)) AS k FROM f WHERE dir IS NOT NULL GROUP BY root, dir)
 SELECT root, path, concat(case when k is not null then concat('d', lpad(k::VARCHAR, 3, '0'), '/') else '' end, 'f', lpad(n::VARCHAR, 6, '0'),
  case when lower(path) LIKE '%.nii.gz' then '.nii.gz' else regexp_extract(base, '(\.[A-Za-z]+)$', 1) end) AS new_path FROM f LEFT JOIN d USING (root, dir)""")
def _(fx):
    return manifest.pseudonymise_paths(fx.manifest.distinct())


@check("f19_slow_tile_flag", """SELECT s_suppkey AS run_id, case when s_suppkey % 9 = 0 then 'failed' when (s_suppkey % 40)/16.0 > 1.5 then 'slow' else 'ok' end AS tile_note FROM supplier""")
def _(fx):
    return reports.slow_tile_flag(_written(fx)).select("run_id", "tile_note")


@check("f20_reduced_tile_flag", "SELECT s_suppkey AS run_id, s_suppkey % 4 = 0 AS tile_reduced, s_suppkey % 6 = 0 AS on_cpu FROM supplier")
def _(fx):
    return reports.reduced_tile_flag(_written(fx)).select("run_id", "tile_reduced", "on_cpu")

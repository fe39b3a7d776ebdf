"""Sliding-window checks."""
from pyspark.sql import functions as F

from suites import check, digest, digest_sql
from suites.fixtures import EDGE
from voxelspark.operators import blocks, tiles
from voxelspark.plans import flows

_TV = """tv AS (SELECT v.scan_id, a.s AS tz, b.s AS ty, c.s AS tx, z - a.s AS dz, y - b.s AS dy, x - c.s AS dx, z, y, x, {cols} FROM {src} v
 JOIN (VALUES (0),(4),(8)) a(s) ON z >= a.s AND z < a.s + 8 JOIN (VALUES (0),(4),(8)) b(s) ON y >= b.s AND y < b.s + 8
 JOIN (VALUES (0),(4),(8)) c(s) ON x >= c.s AND x < c.s + 8)"""


@check("t02_tile_voxels", "WITH " + _TV.format(cols="hu::BIGINT AS h", src="voxels")
       + " SELECT scan_id, tz, ty, tx, count(*) AS n, sum(h)::BIGINT AS total, sum(h*(dz*64 + dy*8 + dx))::BIGINT AS weighted FROM tv GROUP BY ALL")
def _(fx):
    t = blocks.assemble_tiles(blocks.tile_pieces(fx.blocks, fx.scans, (8, 8, 8)))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))      # noqa: E731
    return t.select("scan_id", "tz", "ty", "tx", F.size("hu").cast("long").alias("n"), add("hu").alias("total"),
                    add(F.transform("hu", lambda v, i: v.cast("long") * i)).alias("weighted"))


@check("t02_tile_voxels_rows", "WITH " + _TV.format(cols="hu::BIGINT AS h", src="voxels")
       + " SELECT scan_id, tz, ty, tx, count(*) AS n, sum(h)::BIGINT AS total, sum(h*(dz*64 + dy*8 + dx))::BIGINT AS weighted FROM tv GROUP BY ALL")
def _(fx):
    t = tiles.tile_voxels(fx.voxels, fx.scans, (8, 8, 8))
    h = F.col("hu").cast("long")
    return t.groupBy("scan_id", "tz", "ty", "tx").agg(
        F.count(F.lit(1)).alias("n"), F.sum(h).alias("total"),
        F.sum(h * (F.col("dz") * 64 + F.col("dy") * 8 + F.col("dx"))).alias("weighted"))


def linear_scorer(box):
    """Ten classes, each favouring its own band of intensities."""
    import numpy as np
    return np.stack([c * 16.0 - np.abs(box + 1000.0 - 256.0 * c) for c in range(10)]).astype(np.float32)


_BEST = """best AS (SELECT scan_id, z, y, x, list_position(l, list_max(l)) - 1 AS label FROM (SELECT scan_id, z, y, x,
  list_transform(range(10), lambda c: c*16 - abs(hu::BIGINT + 1000 - 256*c)) AS l FROM voxels))"""


@check("t04_score_tiles", "WITH " + _BEST + "\n" + digest_sql("best", "label"))
def _(fx):
    out = blocks.score_blocks(fx.blocks, fx.scans, linear_scorer, (8, 8, 8), 10, block=EDGE)
    return digest(blocks.voxels_of(blocks.argmax_blocks(out, 10), "label"), F.col("label").cast("long"))


@check("t04_score_tiles_of_rows", "WITH " + _BEST + "\n" + digest_sql("best", "label"))
def _(fx):
    out = flows.score_volumes(fx.voxels, fx.scans, linear_scorer, (8, 8, 8), 10, block=EDGE)
    return digest(blocks.voxels_of(blocks.argmax_blocks(out, 10), "label"), F.col("label").cast("long"))


_W = """greatest(round_even(1000*greatest(exp(-((dz-3.5)*(dz-3.5) + (dy-3.5)*(dy-3.5) + (dx-3.5)*(dx-3.5))/2.0::DOUBLE)/exp(-0.375::DOUBLE), 0.001::DOUBLE), 0), 0)"""


def numbered(key, box):
    """The values of a tile plus a number of its own."""
    import numpy as np
    _, tz, ty, tx = key
    return np.moveaxis(box, -1, 0) + (tz // 4 * 9 + ty // 4 * 3 + tx // 4) % 7


def whole_bell(tile):
    import numpy as np

    from voxelspark.operators.blocks import bell
    return np.rint(1000 * bell(tile))


@check("t05_blend_tiles", "WITH " + _TV.format(cols="logit", src="logits") + f""",
 u AS (SELECT scan_id, z, y, x, unnest(range(10)) AS c, unnest(logit) + ((tz//4*3 + ty//4)*3 + tx//4) % 7 AS l, {_W} AS w FROM tv),
 b AS (SELECT scan_id, z, y, x, c, sum(w*l)/greatest(sum(w), 1e-6) AS v FROM u GROUP BY ALL),
 r AS (SELECT scan_id, z, y, x, sum(round_even(v*1000, 0)*(c + 1))::BIGINT AS h FROM b GROUP BY ALL)
 """ + digest_sql("r", "h"))
def _(fx):
    out = blocks.blended(fx.logit_blocks, fx.scans, numbered, (8, 8, 8), 10, block=EDGE, value="logit", channels=10, weight=whole_bell)
    out = blocks.voxels_of(out, "logit", 10)
    h = sum(F.rint(F.col("logit")[c] * 1000) * (c + 1) for c in range(10))
    return digest(out, h.cast("long"))


@check("t06_argmax_label", "WITH b AS (SELECT scan_id, z, y, x, list_position(logit, list_max(logit)) - 1 AS label FROM logits)\n" + digest_sql("b", "label"))
def _(fx):
    return digest(blocks.voxels_of(blocks.argmax_blocks(fx.logit_blocks, 10), "label"), F.col("label").cast("long"))


@check("t06_argmax_label_rows", "WITH b AS (SELECT scan_id, z, y, x, list_position(logit, list_max(logit)) - 1 AS label FROM logits)\n" + digest_sql("b", "label"))
def _(fx):
    return digest(tiles.argmax_label(fx.logits), F.col("label").cast("long"))


_FIELD = """f0 AS (SELECT scan_id, z, y, x, logit, list_reverse_sort(logit) AS s FROM logits),
 fld AS (SELECT scan_id, z, y, x, list_transform(logit, lambda v: v - case when v = s[1] then s[2] else s[1] end) AS f FROM f0)"""


@check("t07_signed_field", f"WITH {_FIELD}, r AS (SELECT scan_id, z, y, x, list_sum(list_transform(range(10), lambda c: f[c + 1]*(c + 1)))::BIGINT AS h FROM fld)\n" + digest_sql("r", "h"))
def _(fx):
    h = sum(F.col("field")[c] * (c + 1) for c in range(10))
    return digest(tiles.signed_field(fx.logits), h.cast("long"))


@check("t08_silence_outside", f"""WITH {_FIELD}, r AS (SELECT f.scan_id, f.z, f.y, f.x, case when f[2] > 0 and l.label is null then -1 else f[2] end::BIGINT AS h
  FROM fld f LEFT JOIN (SELECT * FROM jaw_labels WHERE label = 1 AND z < 15) l USING (scan_id, z, y, x))
 """ + digest_sql("r", "h"))
def _(fx):
    field = tiles.signed_field(fx.logits).select("scan_id", "z", "y", "x", F.col("field")[1].alias("field"))
    out = tiles.silence_outside(field, fx.labels.filter("label = 1 and z < 15"))
    return digest(out, F.col("field").cast("long"))


@check("t09_tile_timing", """WITH t AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tile,
  (event_id % 40)/16.0::DOUBLE AS seconds, event_type = 'error' AS failed FROM events)
 SELECT run_id, count(*) FILTER (NOT failed) AS tiles, max(seconds) FILTER (tile = 1 AND NOT failed) AS first_seconds,
 round(avg(seconds) FILTER (tile > 1 AND NOT failed), 6) AS mean_seconds, max(seconds) FILTER (tile > 1 AND NOT failed) AS slowest_seconds,
 min(tile) FILTER (failed) AS failed_tile FROM t GROUP BY run_id""")
def _(fx):
    from voxelspark.plans.ordered import number_rows
    e = fx.table("events").selectExpr("user_id AS run_id", "ts", "event_id", "(event_id % 40)/16D AS seconds",
                                      "event_type = 'error' AS failed")
    log = number_rows(e, ["run_id"], F.date_trunc("day", "ts"), ["ts", "event_id"], "tile")
    return tiles.tile_timing(log).withColumn("mean_seconds", F.round("mean_seconds", 6))

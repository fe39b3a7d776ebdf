"""Connected-component checks. The SQL links x runs, which are far fewer than voxels."""
from pyspark.sql import functions as F

from suites import check
from voxelspark.operators import components as C

BLOCK = 8                                     # smaller than the 16^3 frames, so pieces cross blocks


def pieces_sql(source: str, by: str, near: int = 6) -> str:
    """CTEs ``run`` and ``piece`` (one row per x run with its component number and size)."""
    touch = ("(abs(a.z - b.z) + abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1)" if near == 6 else
             "(abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND (a.z <> b.z OR a.y <> b.y) AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1)")
    return f"""run0 AS (SELECT scan_id, {by} AS g, z, y, min(x) AS x0, max(x) AS x1 FROM
  (SELECT *, x - row_number() OVER (PARTITION BY scan_id, {by}, z, y ORDER BY x) AS r FROM {source}) GROUP BY scan_id, {by}, z, y, r),
 run AS (SELECT *, (z*2097152::BIGINT + y)*2097152 + x0 AS node, x1 - x0 + 1 AS len FROM run0),
 link AS (SELECT a.scan_id, a.g, a.node AS u, b.node AS v FROM run a JOIN run b ON a.scan_id = b.scan_id AND a.g = b.g
  AND b.z BETWEEN a.z - 1 AND a.z + 1 AND {touch}),
 cc(scan_id, g, node, comp) USING KEY (scan_id, g, node) AS (SELECT scan_id, g, node, node FROM run UNION
  SELECT e.scan_id, e.g, e.v, min(c.comp) FROM cc c JOIN link e ON e.scan_id = c.scan_id AND e.g = c.g AND e.u = c.node
  JOIN recurring.cc r ON r.scan_id = e.scan_id AND r.g = e.g AND r.node = e.v WHERE c.comp < r.comp GROUP BY ALL),
 piece AS (SELECT r.*, c.comp, sum(len) OVER (PARTITION BY r.scan_id, r.g, comp)::BIGINT AS size FROM run r JOIN cc c USING (scan_id, g, node)),
 comps AS (SELECT scan_id, g, comp, size, row_number() OVER (PARTITION BY scan_id, g ORDER BY size DESC, comp) AS rank
  FROM (SELECT DISTINCT scan_id, g, comp, size FROM piece))"""


JAW = "WITH RECURSIVE " + pieces_sql("jaw_labels", "label")
EXPAND = "SELECT scan_id, {cols}, z, y, unnest(range(x0, x1 + 1)) AS x FROM piece"


@check("c01_connected_components", JAW + " " + EXPAND.format(cols="g AS label, comp"))
def _(fx):
    parts = C.connected_components(fx.labels, block=BLOCK)
    return parts.join(parts.sizes().select(*parts.keys, "comp"))


@check("c01_connected_components_26", "WITH RECURSIVE " + pieces_sql("voxels WHERE hu > 1300", "1::INT", 26)
       + " SELECT scan_id, comp, size AS n FROM comps")
def _(fx):
    parts = C.connected_components(fx.voxels.filter("hu > 1300"), by=(), connectivity=26, block=BLOCK)
    return parts.sizes().select("scan_id", "comp", "n")


@check("c02_relabel_by_size", JAW + " SELECT p.scan_id, p.g AS label, rank AS component, z, y, unnest(range(x0, x1 + 1)) AS x FROM piece p JOIN comps USING (scan_id, g, comp)")
def _(fx):
    return C.relabel_by_size(C.connected_components(fx.labels, block=BLOCK))


@check("c03_drop_small", JAW + " " + EXPAND.format(cols="g AS label") + " WHERE size >= greatest(1, floor(3.3::DOUBLE/0.216::DOUBLE))")
def _(fx):
    return C.drop_small(C.connected_components(fx.labels, block=BLOCK), fx.qc_scans, 3.3)


_MIN = "case g when 1 then 1.0::DOUBLE when 5 then 0.02::DOUBLE else 0.02::DOUBLE end"


@check("c04_count_components", JAW + f""" SELECT scan_id, g AS label, count(*) AS raw, count(*) FILTER (size >= m) AS components,
 coalesce(sum(size) FILTER (size >= m), 0)::BIGINT AS voxels, count(*) FILTER (size < m) AS specks
 FROM (SELECT *, greatest(1, floor({_MIN}/0.216::DOUBLE)) AS m FROM comps) GROUP BY ALL""")
def _(fx):
    return C.count_components(C.connected_components(fx.labels, block=BLOCK), fx.qc_scans)


@check("c05_largest_component", JAW + " SELECT * FROM (SELECT p.scan_id, p.g AS label, z, y, unnest(range(x0, x1 + 1)) AS x FROM piece p JOIN comps USING (scan_id, g, comp) WHERE rank = 1) WHERE x >= 3 AND x < 12")
def _(fx):
    parts = C.connected_components(fx.labels, block=BLOCK)
    return C.largest_component(parts, (F.lit(3), F.lit(12)))

"""Scans, voxels, labels and logs derived from the test tables by closed formulas.

Every formula is integer arithmetic spelled once and used by both engines.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.session import grid_partitions

N = 16
EDGE = 6                                       # of the array blocks

HU = """case when (2*x-15)*(2*x-15)+(2*y-15)*(2*y-15) > 256 then -1000
 when z between 6 and 9 and y between 6 and 9 and x between 5 and 10 then 1400 + h
 when z between 4 and 11 and y between 3 + k % 3 and 12 and x between 3 and 12 then 60 + h
 when h = 0 and z in (2, 13) then 1400
 else -900 + h end"""
H = "(z*7919 + y*104729 + x*1299709 + k*15485863) % 97 - 48"
LABEL = """case when z=3 and x=4 and y between 4 and 11 and (k%4<>3 or x<=7) then 5
 when z=3 and x=11 and y between 4 and 11 and k%4=0 then 5
 when z=3 and x=11 and y in (4,5,8,9,11) and k%4=1 then 5
 when z between 2 and 5 and y between 2 and 13
  and x between 1 and (case when k%4=3 then 7 else 14 end) then 1
 when z between 10 and 12 and y between 5 and 7 and x between 2 and 13 and x%3<>1 then 3
 when z between 7 and 8 and y between 5 and 7 and x between 2 and 13 and x%3<>1 then 4
 when z=15 and y=15 and x=15 and k%2=0 then 1
 else 0 end"""
TOOTH = """case when label = 3 and k % 5 = 1 and x >= 11 then 33
 when label = 3 and k % 5 = 2 and x >= 11 and z = 10 then 1
 when label = 3 and k % 5 = 0 and z = 12 then cast(floor((x+1)/3.0) as int) + 4
 when label = 3 then cast(floor((x+1)/3.0) as int)
 else cast(floor((x+1)/3.0) as int) + 16 end"""
SPACING = "case k % 5 when 0 then 0.15D when 1 then 0.3D when 2 then 0.4D when 3 then 0.9D else 1.5D end"
LINE = """case seq % 12
 when 0 then 'reading: scan.mha' when 1 then '  resampled to LPS, 0.3 mm'
 when 2 then 'computing on: GPU' when 3 then concat('tile ', cast(seq % 7 + 1 as {s}), '/8')
 when 4 then '  surfaces prepared' when 5 then '  Mandible: 12.5 cm3'
 when 6 then 'separating teeth (numbering)' when 7 then '  upper arch: 8 teeth'
 when 8 then 'ERROR: out of memory' when 9 then 'ERROR: 887a0005 device removed'
 when 10 then 'done in 12.5 s' else '' end"""
GUARD = """case event_id % 9
 when 0 then concat('open D:\\Dental\\case', cast(user_id as {s}))
 when 1 then '/media/anyone/0123ABCD/Dental/set'
 when 2 then 'see /archive/post_op/scan'
 when 3 then concat('20240101_101010_', lpad(cast(user_id % 1000 as {s}), 3, '0'))
 when 4 then 'copied 01 02 23 Sample'
 when 5 then 'by Dr. Example, D:\\Dental\\kept'
 when 6 then concat('mentions Quuxword in ', event_type)
 when 7 then concat('Проба АБ.dcm ', event_type)
 else concat('plain text ', cast(event_id as {s})) end"""
DIFF = """case event_id % 7 when 0 then 'diff --git a/x b/x'
 when 1 then concat('+++ b/f', cast(user_id as {s}))
 when 2 then concat('+added ', event_type) when 3 then concat('-removed ', event_type)
 when 4 then concat('+', cast(event_id as {s})) when 5 then ' context'
 else '+++++ not a header' end"""



def _chars(text: str, dialect: str) -> str:
    return text.format(s="string" if dialect == "spark" else "varchar")


DUCK_SPACING = ("case k % 5 when 0 then 0.15::DOUBLE when 1 then 0.3::DOUBLE "
                "when 2 then 0.4::DOUBLE when 3 then 0.9::DOUBLE else 1.5::DOUBLE end")

CTES: dict[str, str] = {
    "scans": f"""SELECT scan_id, 16 AS nx, 16 AS ny, 16 AS nz, sp AS sx, sp AS sy, sp AS sz,
  -10.0::DOUBLE AS ox, 20.0::DOUBLE AS oy, 5.0::DOUBLE AS oz,
  case when scan_id % 7 = 0 then -1.0::DOUBLE else 1.0::DOUBLE end AS dxx
  FROM (SELECT s_suppkey AS scan_id, s_suppkey AS k, {DUCK_SPACING} AS sp FROM supplier)""",
    "headers": f"""SELECT k AS scan_id, 200 + (k*37)%500 AS nx, 200 + (k*53)%500 AS ny,
  100 + (k*71)%600 AS nz, sp AS sx, sp AS sy, sz,
  (k%11) * 2.5 - 10.0::DOUBLE AS ox, (k%13) * 1.5::DOUBLE AS oy, (k%17) * -0.5::DOUBLE AS oz,
  case k%4 when 0 then [1,0,0,0,1,0,0,0,1]::DOUBLE[] when 1 then [-1,0,0,0,-1,0,0,0,1]::DOUBLE[]
   when 2 then [0,1,0,0,0,-1,1,0,0]::DOUBLE[] else [0.8,-0.6,0,0.6,0.8,0,0,0,1]::DOUBLE[] end AS d
  FROM (SELECT k, {DUCK_SPACING} AS sp,
   case (k+1) % 5 when 0 then 0.15::DOUBLE when 1 then 0.3::DOUBLE when 2 then 0.4::DOUBLE
    when 3 then 0.9::DOUBLE else 0.03::DOUBLE end AS sz
   FROM (SELECT s_suppkey AS k FROM supplier))""",
    "voxels": f"""SELECT scan_id, z, y, x, {HU} AS hu FROM (SELECT s_suppkey AS scan_id,
  s_suppkey AS k, z, y, x, {H.replace('k*', 's_suppkey*')} AS h FROM supplier,
  range(16) a(z), range(16) b(y), range(16) c(x))""",
    "jaw_labels": f"""SELECT * FROM (SELECT s_suppkey AS scan_id, z, y, x,
  {LABEL.replace('k%', 's_suppkey%')} AS label FROM supplier, range(16) a(z), range(16) b(y), range(16) c(x))
  WHERE label > 0""",
    "ours": """SELECT * FROM (SELECT scan_id, z, y, x + case when scan_id%3=0 then 1 else 0 end AS x, label
  FROM jaw_labels WHERE NOT (label = 5 AND scan_id % 5 = 0)) WHERE x < 16""",
    "truth": "SELECT scan_id, z, y, x, label FROM jaw_labels WHERE NOT (label = 5 AND scan_id % 10 = 0)",
    "other": """SELECT * FROM (SELECT scan_id, z, y + case when scan_id%3=1 then 1 else 0 end AS y, x, label
  FROM jaw_labels) WHERE y < 16""",
    "logits": """SELECT scan_id, z, y, x, list_transform(range(10), lambda c:
   5000 * (case when label = c then 1 else 0 end) + (z*31 + y*17 + x*7 + c*13 + scan_id) % 1000) AS logit
  FROM (SELECT v.scan_id, v.z, v.y, v.x, coalesce(l.label, 0) AS label
   FROM (SELECT s_suppkey AS scan_id, z, y, x FROM supplier, range(16) a(z), range(16) b(y), range(16) c(x)) v
   LEFT JOIN jaw_labels l USING (scan_id, z, y, x))""",
    "tooth_pred": f"""SELECT scan_id, z, y, x, {TOOTH} AS id FROM
  (SELECT *, scan_id AS k FROM jaw_labels WHERE label IN (3, 4))""",
    "tooth_truth": """SELECT scan_id, z, y, x, cast(floor((x+1)/3.0) as int)
   + case when label = 4 then 16 else 0 end AS id FROM jaw_labels WHERE label IN (3, 4)""",
    "run_log": f"""SELECT run_id, seq, ts, {_chars(LINE, 'duck')} AS line FROM (SELECT user_id AS run_id, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)""",
    "guard_lines": f"""SELECT event_id AS line_id,
  case event_id % 4 when 0 then concat('src/file', user_id, '.py') when 1 then NULL
   when 2 then 'data/post_op/a.txt' else concat('docs/', event_type, '.md') end AS path,
  {_chars(GUARD, 'duck')} AS line FROM events
  UNION ALL SELECT 1000000000000 + doc_id, concat('documents/', source), text FROM documents
  UNION ALL SELECT 2000000000000 + conv_id * 1000 + turn, NULL, text FROM conversations
  UNION ALL SELECT 3000000000000 + page_id, url, html FROM pages""",
    "diff_lines": f"SELECT user_id AS diff_id, event_id AS seq, {_chars(DIFF, 'duck')} AS line FROM events",
    "slices": """SELECT l_suppkey AS root, l_returnflag AS dir, concat(l_linestatus, l_linenumber) AS series_uid,
  l_orderkey AS instance, 1 + case when l_partkey % 500 = 0 then 1 else 0 end AS frames FROM lineitem""",
    "manifest": """SELECT l_suppkey AS root, concat(
   case when l_linenumber % 5 = 1 and l_orderkey % 3 = 0 then '' else concat(l_returnflag, '/') end,
   case l_orderkey % 6 when 0 then 'CT' when 1 then 'Скан' else concat('IM', l_orderkey) end,
   case when l_orderkey % 6 < 2 then '' else concat('_', l_partkey) end,
   case l_linenumber % 5 when 0 then '.dcm' when 1 then '.zip' when 2 then '.nii.gz'
    when 3 then '' else '.MHA' end) AS path FROM lineitem""",
}


class Fixtures:
    """The same tables as DataFrames over one test directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def scans(self) -> DataFrame:
        k = self.table("supplier").select(F.col("s_suppkey").alias("scan_id"), F.col("s_suppkey").alias("k"))
        return k.selectExpr(
            "scan_id", f"{N} AS nx", f"{N} AS ny", f"{N} AS nz",
            f"array_repeat({SPACING}, 3) AS spacing", "array(-10D, 20D, 5D) AS origin",
            "array(case when k % 7 = 0 then -1D else 1D end,0D,0D,0D,1D,0D,0D,0D,1D) AS direction")

    @cached_property
    def qc_scans(self) -> DataFrame:
        """The same frames on a 6 mm grid, where limits in mm and cm3 bite."""
        return self.scans.selectExpr(
            "scan_id", "nx", "ny", "nz", "array(6D, 6D, 6D) AS spacing", "origin",
            "array(1D,0D,0D,0D,1D,0D,0D,0D,1D) AS direction")

    @cached_property
    def tooth_truth(self) -> DataFrame:
        return self.labels.filter("label in (3, 4)").selectExpr(
            "scan_id", "z", "y", "x",
            "cast(floor((x+1)/3.0) + case when label = 4 then 16 else 0 end as short) AS id")

    @cached_property
    def headers(self) -> DataFrame:
        k = self.table("supplier").select(F.col("s_suppkey").alias("k"))
        sz = ("case (k+1) % 5 when 0 then 0.15D when 1 then 0.3D when 2 then 0.4D "
              "when 3 then 0.9D else 0.03D end")
        return k.selectExpr(
            "k AS scan_id", "cast(200 + (k*37)%500 as int) AS nx", "cast(200 + (k*53)%500 as int) AS ny",
            "cast(100 + (k*71)%600 as int) AS nz", f"array({SPACING}, {SPACING}, {sz}) AS spacing",
            "array((k%11)*2.5D - 10D, (k%13)*1.5D, (k%17)*-0.5D) AS origin",
            "case k%4 when 0 then array(1D,0D,0D,0D,1D,0D,0D,0D,1D) when 1 then array(-1D,0D,0D,0D,-1D,0D,0D,0D,1D)"
            " when 2 then array(0D,1D,0D,0D,0D,-1D,1D,0D,0D)"
            " else array(0.8D,-0.6D,0D,0.6D,0.8D,0D,0D,0D,1D) end AS direction")

    @cached_property
    def _grid(self) -> DataFrame:
        axis = F.sequence(F.lit(0), F.lit(N - 1))
        k = self.table("supplier").select(F.col("s_suppkey").alias("scan_id"))
        planes = k.withColumn("z", F.explode(axis))
        planes = planes.repartition(grid_partitions(self.spark), "scan_id", "z")
        return (planes.withColumn("y", F.explode(axis)).withColumn("x", F.explode(axis))
                .withColumn("k", F.col("scan_id")))

    @cached_property
    def voxels(self) -> DataFrame:
        return self._grid.withColumn("h", F.expr(H)).selectExpr(
            "scan_id", "z", "y", "x", f"explode(array(cast({HU} as float))) AS hu")

    @cached_property
    def labels(self) -> DataFrame:
        # generated, so that filters on the label compare it and do not work out the formula again
        return self._grid.selectExpr("scan_id", "z", "y", "x", f"explode(array(cast({LABEL} as short))) AS label").filter("label > 0")

    @cached_property
    def truth(self) -> DataFrame:
        return self.labels.filter("not (label = 5 and scan_id % 10 = 0)")

    @cached_property
    def ours(self) -> DataFrame:
        return (self.labels.filter("not (label = 5 and scan_id % 5 = 0)")
                .selectExpr("scan_id", "z", "y", "x + case when scan_id%3=0 then 1 else 0 end AS x", "label")
                .filter(f"x < {N}"))

    @cached_property
    def other(self) -> DataFrame:
        return self.labels.selectExpr(
            "scan_id", "z", "y + case when scan_id%3=1 then 1 else 0 end AS y", "x", "label").filter(f"y < {N}")

    @cached_property
    def logits(self) -> DataFrame:
        return self._logits(self._grid).select("scan_id", "z", "y", "x", "logit")

    @staticmethod
    def _logits(grid: DataFrame) -> DataFrame:
        """Ten expressions a voxel, none a lambda: those are not compiled."""
        grid = grid.selectExpr("*", f"{LABEL} AS _one", "z*31 + y*17 + x*7 + k AS _at")
        return grid.selectExpr("*", "array(" + ", ".join(
            f"cast(5000 * (case when _one = {c} then 1 else 0 end) + (_at + {c * 13}) % 1000 as float)" for c in range(10)) + ") AS logit")

    def _blocks(self, rows: Callable[[DataFrame], DataFrame], value: str, each: int = 1) -> DataFrame:
        """The same volumes as array blocks, whose edge divides neither the frame nor the tiles; no shuffle of voxels.

        Voxels are made a block after the other, each block's in order, and packed as they come."""
        b = self.table("supplier").select(F.col("s_suppkey").alias("scan_id"), F.col("s_suppkey").alias("k"))
        b = b.repartition(grid_partitions(self.spark), "scan_id")
        for a in "zyx":
            b = b.withColumn(f"{a}0", F.explode(F.sequence(F.lit(0), F.lit(N - 1), F.lit(EDGE))))
        for a in "zyx":
            b = b.withColumn(a, F.explode(F.sequence(F.col(f"{a}0"), F.least(F.col(f"{a}0") + (EDGE - 1), F.lit(N - 1)))))

        def pack(batches):
            rest = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                t = t if rest is None else pa.concat_tables([rest, t])
                at = np.stack([t.column(c).to_numpy() for c in ("scan_id", "z0", "y0", "x0")], 1)
                first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
                yield from done(t.slice(0, first[-1]), at[first[:-1]], first)
                rest = t.slice(first[-1]).combine_chunks()
            if rest is not None:
                at = np.array([[rest.column(c)[0].as_py() for c in ("scan_id", "z0", "y0", "x0")]])
                yield from done(rest, at, np.array([0, len(rest)]))

        def done(t, at, first):
            if len(at):
                flat = t.column(value).combine_chunks()
                flat = flat.flatten() if each > 1 else flat
                shape = np.minimum(EDGE, N - at[:, 1:]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[:, 0]), *[pa.array(at[:, i].astype(np.int32)) for i in (1, 2, 3)],
                     pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(at) + 1, 3, dtype=np.int32)), pa.array(shape.ravel())),
                     pa.ListArray.from_arrays(pa.array((first * each).astype(np.int32)), flat)],
                    ["scan_id", "z0", "y0", "x0", "shape", value])
        return rows(b).select("scan_id", "z0", "y0", "x0", value).mapInArrow(
            pack, f"scan_id long, z0 int, y0 int, x0 int, shape array<int>, {value} array<float>")

    @cached_property
    def blocks(self) -> DataFrame:
        return self._blocks(lambda g: g.withColumn("h", F.expr(H)).withColumn("hu", F.expr(f"cast({HU} as float)")), "hu")

    @cached_property
    def logit_blocks(self) -> DataFrame:
        return self._blocks(self._logits, "logit", 10)

    @cached_property
    def tooth_pred(self) -> DataFrame:
        return self.labels.filter("label in (3, 4)").withColumn("k", F.col("scan_id")).selectExpr(
            "scan_id", "z", "y", "x", f"explode(array(cast({TOOTH} as short))) AS id")

    @cached_property
    def run_log(self) -> DataFrame:
        from voxelspark.plans.ordered import number_rows
        e = self.table("events").select(F.col("user_id").alias("run_id"), "ts", "event_id")
        numbered = number_rows(e, ["run_id"], F.date_trunc("day", "ts"), ["ts", "event_id"], "seq")
        return (numbered.withColumn("seq", F.col("seq") - 1)
                .selectExpr("run_id", "seq", "ts", f"{_chars(LINE, 'spark')} AS line"))

    @cached_property
    def guard_lines(self) -> DataFrame:
        built = self.table("events").selectExpr(
            "event_id AS line_id",
            "case event_id % 4 when 0 then concat('src/file', user_id, '.py') when 1 then cast(null as string)"
            " when 2 then 'data/post_op/a.txt' else concat('docs/', event_type, '.md') end AS path",
            _chars(GUARD, "spark").replace("\\", "\\\\") + " AS line")
        docs = self.table("documents").selectExpr("1000000000000 + doc_id", "concat('documents/', source)", "text")
        turns = self.table("conversations").selectExpr("2000000000000 + conv_id * 1000 + turn", "cast(null as string)", "text")
        pages = self.table("pages").selectExpr("3000000000000 + page_id", "url", "html")
        return built.union(docs).union(turns).union(pages)

    @cached_property
    def diff_lines(self) -> DataFrame:
        return self.table("events").selectExpr("user_id AS diff_id", "event_id AS seq", _chars(DIFF, "spark") + " AS line")

    @cached_property
    def slices(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_suppkey AS root", "l_returnflag AS dir", "concat(l_linestatus, l_linenumber) AS series_uid",
            "l_orderkey AS instance", "1 + case when l_partkey % 500 = 0 then 1 else 0 end AS frames")

    @cached_property
    def manifest(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_suppkey AS root", """concat(
   case when l_linenumber % 5 = 1 and l_orderkey % 3 = 0 then '' else concat(l_returnflag, '/') end,
   case l_orderkey % 6 when 0 then 'CT' when 1 then 'Скан' else concat('IM', l_orderkey) end,
   case when l_orderkey % 6 < 2 then '' else concat('_', l_partkey) end,
   case l_linenumber % 5 when 0 then '.dcm' when 1 then '.zip' when 2 then '.nii.gz'
    when 3 then '' else '.MHA' end) AS path""")

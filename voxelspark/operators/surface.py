"""Isosurfaces: edge vertices, triangles and mesh facts, welding."""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelspark.functions.geometry import AXES, to_physical
from voxelspark.plans.attach import attach
from voxelspark.plans.ordered import number_rows


def _next(value: Column | str, axis: str) -> Column:
    others = [a for a in "zyx" if a != axis]
    line = W.partitionBy("scan_id", *others).orderBy(axis)
    return F.when(F.lead(axis).over(line) == F.col(axis) + 1, F.lead(value).over(line))


def _geometry(scans: DataFrame) -> DataFrame:
    return scans.select("scan_id", "origin", "spacing", "direction")


def iso_vertices(field: DataFrame, scans: DataFrame, iso: float = 0.0, value: str = "hu") -> DataFrame:
    """One vertex (patient mm) per grid edge whose ends lie on different sides of ``iso``."""
    rows = field.select("scan_id", "z", "y", "x", F.col(value).cast("double").alias("v")).repartition("scan_id", "z")
    for axis in "xyz":
        rows = rows.withColumn(f"_{axis}", _next("v", axis))
    v = F.col("v")
    edges = []
    for axis in AXES:
        far = F.col(f"_{axis}")
        at = [(F.col(a) + (F.lit(iso) - v) / (far - v)) if a == axis else F.col(a).cast("double") for a in AXES]
        edges.append(F.when((v >= iso) != (far >= iso), F.struct(
            F.lit(axis).alias("axis"), *[c.alias(a) for c, a in zip(at, AXES)])))
    hit = rows.select("scan_id", F.explode(F.array(*edges)).alias("e")).filter(F.col("e").isNotNull())
    hit = attach(hit, _geometry(scans), sized_by=scans, salt_by=("e",))
    p = to_physical([F.col(f"e.{a}") for a in AXES])
    return hit.select("scan_id", "e.axis", *[c.alias(a) for c, a in zip(p, AXES)])


def tetrahedra() -> list[list[int]]:
    """The six tetrahedra of a cube around one diagonal; corner = x + 2y + 4z bits."""
    return [[0, a, a + b, 7] for a, b, _ in permutations((1, 2, 4))]


def tetra_cases() -> list[list[list[tuple[int, int]]]]:
    """Per case (bit i set: corner i inside) the triangles, as (inside, outside) edges."""
    table = []
    for case in range(16):
        ins = [i for i in range(4) if case >> i & 1]
        out = [i for i in range(4) if not case >> i & 1]
        if len(ins) == 2:
            (a, b), (c, d) = ins, out
            table.append([[(a, c), (a, d), (b, d)], [(a, c), (b, d), (b, c)]])
        else:
            ring = [(i, o) for i in ins for o in out]
            table.append([ring] if len(ring) == 3 else [])
    return table


def iso_triangles(field: DataFrame, scans: DataFrame, iso: float = 0.0, value: str = "hu") -> DataFrame:
    """Triangles of the isosurface in patient mm, corners ordered so that normals point outwards.

    Cells come from line windows; only cells the surface passes through are
    split into tetrahedra. Same zero set as marching cubes, other triangles.
    """
    rows = field.select("scan_id", "z", "y", "x", F.col(value).cast("double").alias("v")).repartition("scan_id", "z")
    rows = rows.select("scan_id", "z", "y", "x", F.array("v", _next("v", "x")).alias("c"))
    rows = rows.select("scan_id", "z", "y", "x", F.concat("c", _next("c", "y")).alias("c"))
    rows = rows.select("scan_id", "z", "y", "x", F.concat("c", _next("c", "z")).alias("c"))
    full = F.col("c").isNotNull() & ~F.exists("c", lambda v: v.isNull())
    cells = rows.filter(full & (F.array_min("c") < iso) & (F.array_max("c") >= iso))
    tets = F.array(*[F.array(*[F.lit(c) for c in t]) for t in tetrahedra()])
    cells = cells.withColumn("t", F.explode(tets))
    case = sum(F.when(F.get("c", F.col("t")[i]) >= iso, 1 << i).otherwise(0) for i in range(4))
    edge = "array<array<struct<a:int,b:int>>>"
    table = F.array(*[F.array(*[F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in tri])
                               for tri in tris]).cast(edge) for tris in tetra_cases()])
    cells = cells.withColumn("tri", F.explode(F.get(table, case)))
    cells = attach(cells, _geometry(scans), sized_by=scans)

    def corner(c: Column) -> list[Column]:
        return [(c.bitwiseAND(bit) != 0).cast("double") for bit in (1, 2, 4)]

    def point(e: Column) -> Column:
        a, b = F.get("t", e["a"]), F.get("t", e["b"])
        va, vb = F.get("c", a), F.get("c", b)
        part = (F.lit(iso) - va) / (vb - va)
        index = [F.col(n) + p + (q - p) * part for n, p, q in zip(AXES, corner(a), corner(b))]
        return F.struct(*[v.alias(n) for v, n in zip(to_physical(index), AXES)])
    first = F.col("tri")[0]
    ends = [to_physical(corner(F.get("t", first[k]))) for k in ("a", "b")]
    cells = cells.select("scan_id", *[point(F.col("tri")[i]).alias(f"p{i}") for i in range(3)],
                         F.array(*[q - p for p, q in zip(*ends)]).alias("out"))
    normal = _cross(_minus("p1", "p0"), _minus("p2", "p0"))
    facing = sum(n * F.col("out")[i] for i, n in enumerate(normal)) >= 0
    return cells.select("scan_id", "p0", F.when(facing, F.col("p1")).otherwise(F.col("p2")).alias("p1"),
                        F.when(facing, F.col("p2")).otherwise(F.col("p1")).alias("p2"))


def _minus(p: str, q: str) -> list[Column]:
    return [F.col(f"{p}.{a}") - F.col(f"{q}.{a}") for a in AXES]


def _cross(u, v) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def mesh_facts(triangles: DataFrame) -> DataFrame:
    """Per scan: triangle count, area (mm2), enclosed volume (mm3) and bounds."""
    n = _cross(_minus("p1", "p0"), _minus("p2", "p0"))
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    p1, p2 = [F.col(f"p1.{a}") for a in AXES], [F.col(f"p2.{a}") for a in AXES]
    wedge = sum(F.col(f"p0.{a}") * c for a, c in zip(AXES, _cross(p1, p2))) / 6
    return triangles.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("triangles"), F.sum(area).alias("area_mm2"), F.sum(wedge).alias("volume_mm3"),
        *[F.min(F.least(*[f"p{i}.{a}" for i in range(3)])).alias(f"min_{a}") for a in AXES],
        *[F.max(F.greatest(*[f"p{i}.{a}" for i in range(3)])).alias(f"max_{a}") for a in AXES])


def weld_vertices(soup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct corners numbered from 0 in (x, y, z) order per mesh, and faces as numbers.

    ``soup``: mesh_id, tri, corner (0..2), x, y, z. Returns (vertices, faces).
    """
    distinct = soup.select("mesh_id", *AXES).distinct()
    verts = number_rows(distinct, ["mesh_id"], F.floor("x"), list(AXES), "vertex")
    verts = verts.withColumn("vertex", F.col("vertex") - 1)
    keyed = soup.join(verts, ["mesh_id", *AXES])
    faces = keyed.groupBy("mesh_id", "tri").agg(
        *[F.max(F.when(F.col("corner") == i, F.col("vertex"))).alias(f"v{i}") for i in range(3)])
    return verts, faces

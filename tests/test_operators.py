"""Brute-force and property checks on small fixtures."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from voxelspark.functions import geometry as G
from voxelspark.functions import tiling
from voxelspark.operators import blocks, canal, components as C, crop, guard, halo, histogram, instances, measure, runs, stencil, surface
from voxelspark.plans import attach as A
from voxelspark.plans import flows, ordered
from voxelspark.session import tune
from voxelspark.sources import config, manifest, preview, reports, volumes

UNIT = ([1.0, 0, 0, 0, 1, 0, 0, 0, 1.0])


@pytest.fixture(autouse=True)
def _tuned(spark):
    tune(spark)


def heads(spark, n=(16, 16, 16), spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), direction=UNIT, scans=(1,)):
    return spark.createDataFrame(
        [(s, *n, list(map(float, spacing)), list(map(float, origin)), list(map(float, direction))) for s in scans],
        "scan_id long, nx int, ny int, nz int, spacing array<double>, origin array<double>, direction array<double>")


def voxels(spark, cells, extra="label short", scan=1):
    return spark.createDataFrame([(scan, *c) for c in cells], f"scan_id long, z int, y int, x int, {extra}")


def brute_components(cells, near):
    left, out = set(cells), []
    while left:
        todo, piece = [left.pop()], set()
        while todo:
            p = todo.pop()
            piece.add(p)
            for d in itertools.product((-1, 0, 1), repeat=3):
                q = tuple(a + b for a, b in zip(p, d))
                if q in left and (near == 26 or sum(map(abs, d)) == 1):
                    left.remove(q)
                    todo.append(q)
        out.append(piece)
    return out


@pytest.mark.parametrize("near", [6, 26])
@pytest.mark.parametrize("block", [3, 8, 64])
def test_components_do_not_depend_on_blocks(spark, near, block):
    rng = random.Random(near)
    cells = {(rng.randrange(14), rng.randrange(14), rng.randrange(14)) for _ in range(620 if near == 6 else 260)}
    want = sorted((min(p), len(p)) for p in brute_components(cells, near))
    parts = C.connected_components(voxels(spark, [(*c, 1) for c in cells]), connectivity=near, block=block)
    got = sorted(((r.comp >> 42, r.comp >> 21 & 2097151, r.comp & 2097151), r.n) for r in parts.sizes().collect())
    assert got == want


def test_long_snake_is_one_component(spark):
    cells = [(0, y, x) for y in range(0, 40, 2) for x in range(40)]
    cells += [(0, y, 39 if y % 4 == 1 else 0) for y in range(1, 39, 2)]
    parts = C.connected_components(voxels(spark, [(*c, 1) for c in cells]), block=4)
    assert [r.n for r in parts.sizes().collect()] == [len(cells)]


def test_clean_arch_takes_in_near_pieces_only(spark):
    big = [(z, y, x) for z in range(4) for y in range(4) for x in range(4)]
    near = [(1, 1, x) for x in range(7, 9)]                   # 3 voxels away
    chained = [(1, 1, x) for x in range(12, 14)]              # reachable through the first
    far = [(1, 1, 25), (1, 1, 26)]
    speck = [(3, 3, 6)]                                       # small, but near
    mask = spark.createDataFrame(
        [(1, *c) for c in big + near + chained + far + speck], "scan_id long, z int, y int, x int")
    out = instances.clean_arch_mask(mask, heads(spark, (40, 16, 16)), min_cm3=0.05, gap_mm=3.0, block=8)
    assert {(r.z, r.y, r.x) for r in out.collect()} == set(big + near + chained + speck)


def test_clean_arch_without_large_piece_keeps_the_largest(spark):
    mask = spark.createDataFrame([(1, 0, 0, x) for x in (0, 1, 2, 30, 31)], "scan_id long, z int, y int, x int")
    out = instances.clean_arch_mask(mask, heads(spark, (40, 16, 16)), block=8)
    assert {r.x for r in out.collect()} == {0, 1, 2}


def test_contacts_settle_smallest_first():
    # 2 is a slice of 1 (5 of 10 faces), 4 an isolated speck, 5 sound
    count = {1: 100, 2: 5, 4: 1, 5: 90}
    faces = {(1, 2): 5, (2, 1): 5, (1, 0): 60, (2, 0): 5, (4, 0): 6, (5, 0): 80, (5, 33): 10, (33, 5): 10}
    moved, notes = instances.settle_contacts(count, faces, (1, 16), 0.01, {})
    assert moved == {4: 0, 2: 1}
    assert [n.split()[1:3] for n in notes] == [["14", "dropped:"], ["12", "merged"]]


def test_contacts_settle_a_whole_chain():
    # a chain of slices: each merge makes the next visible, until one number remains
    count = {i: i for i in range(1, 13)}
    faces = {}
    for i in range(1, 12):
        faces[i, i + 1] = faces[i + 1, i] = 10
    moved, notes = instances.settle_contacts(count, faces, (1, 16), 1.0, {})
    assert len(notes) == 11 and len(set(moved.values())) == 1 and len(moved) == 11


def test_qc_merge_moves_voxels(spark):
    tooth = [(z, y, x, 1 if z < 3 else 2) for z in range(4) for y in range(4) for x in range(4)]
    out, notes = instances.qc_merge(voxels(spark, tooth, "id short"), heads(spark), (1, 16))
    assert {r.id for r in out.collect()} == {1} and out.count() == 64
    assert "merged into 11" in notes.first().notes[0]


def test_nearest_label_matches_brute_force(spark):
    rng = random.Random(5)
    seeds = {(rng.randrange(12), rng.randrange(12), rng.randrange(12)): rng.randrange(1, 9) for _ in range(25)}
    sp = (0.5, 0.7, 0.9)
    targets = [p for p in itertools.product(range(12), repeat=3) if rng.random() < 0.2]
    out = stencil.nearest_label(voxels(spark, [(*p, i) for p, i in seeds.items()], "id int"),
                                spark.createDataFrame(
                                    [(1, *t) for t in targets], "scan_id long, z int, y int, x int"),
                                heads(spark, (12, 12, 12), sp), 2.0, "id")
    got = {(r.z, r.y, r.x): (round(r.distance, 6), r.near) for r in out.collect()}
    want = {}
    for t in targets:
        best = min((round(math.sqrt(sum(((a - b) * s) ** 2 for a, b, s in zip(p, t, sp[::-1]))), 6), i)
                   for p, i in seeds.items())
        if best[0] <= 2.0:
            want[t] = best
    assert got == want


def test_contacts_are_symmetric(spark):
    rng = random.Random(2)
    cells = [(*p, rng.randrange(1, 4)) for p in itertools.product(range(6), repeat=3) if rng.random() < 0.6]
    out = {(r.a, r.b): r.faces for r in stencil.contacts(voxels(spark, cells), heads(spark, (6, 6, 6))).collect()}
    for (a, b), n in out.items():
        assert b == 0 or out[b, a] == n


def test_sphere_area_volume_and_winding(spark):
    r, n = 6.3, 18
    cells = [(z, y, x, r - math.dist((z, y, x), (8.5, 8.5, 8.5))) for z, y, x in itertools.product(range(n), repeat=3)]
    field = voxels(spark, cells, "hu double")
    for flip in (1.0, -1.0):
        scans = heads(spark, (n, n, n), (0.5, 0.5, 0.5), direction=[flip, 0, 0, 0, 1, 0, 0, 0, 1])
        m = surface.mesh_facts(surface.iso_triangles(field, scans)).first()
        assert m.volume_mm3 == pytest.approx(4 / 3 * math.pi * (r / 2) ** 3, rel=0.03)
        assert m.area_mm2 == pytest.approx(4 * math.pi * (r / 2) ** 2, rel=0.03)
    assert len(surface.tetra_cases()) == 16 and len(surface.tetrahedra()) == 6


@pytest.mark.parametrize("n,tile", [(16, 8), (17, 8), (5, 8), (30, 7)])
def test_every_position_is_covered_by_its_tiles(spark, n, tile):
    df = spark.range(1).select(F.lit(n).alias("n"), F.lit(tile).alias("t"))
    starts = df.select(tiling.starts(F.greatest("n", "t"), F.col("t"))).first()[0]
    rows = spark.range(max(n, tile)).select("id", tiling.covering_starts(F.col("id").cast("int"), F.lit(n), tile).alias("c"))
    for r in rows.collect():
        assert sorted(r.c) == [s for s in sorted(starts) if s <= r.id < s + tile] != []


def test_blend_of_constant_logits_is_constant_and_thin_scans_are_padded(spark):
    cells = [(z, y, x, float(x)) for z in range(3) for y in range(9) for x in range(10)]
    for block in (3, 4, 64):                    # tiles larger than a block, as large, and smaller
        out = flows.score_volumes(voxels(spark, cells, "hu float"), heads(spark, (10, 9, 3)),
                                  lambda b: np.stack([np.full(b.shape, 2.5), b]), (4, 4, 4), 2, block=block)
        rows = blocks.voxels_of(out, "logit", 2).collect()
        assert sorted((r.z, r.y, r.x) for r in rows) == sorted(c[:3] for c in cells)
        for r in rows:
            assert r.logit[0] == pytest.approx(2.5) and r.logit[1] == pytest.approx(r.x, abs=1e-4)


def plain_blend(box, tile, score, overlap):
    """One volume scored and blended the plain way."""
    from voxelspark.operators.blocks import bell
    big = np.pad(box, [(0, max(0, t - n)) for t, n in zip(tile, box.shape)], mode="edge")
    def starts(n, t):
        step = max(1, round(t * (1 - overlap)))
        return sorted({*range(0, n - t + 1, step), n - t})
    total, mass = 0, np.zeros(big.shape)
    for at in itertools.product(*[starts(n, t) for n, t in zip(big.shape, tile)]):
        own = tuple(slice(a, a + t) for a, t in zip(at, tile))
        out = score(big[own])
        if isinstance(total, int):
            total = np.zeros((len(out), *big.shape))
        total[(slice(None), *own)] += bell(tile) * out
        mass[own] += bell(tile)
    return (total / mass)[(slice(None), *[slice(0, n) for n in box.shape])]


def place_scorer(box):
    """What a voxel gets depends on where in the tile it is."""
    return np.stack([box, box * np.linspace(0, 1, box.shape[2]), np.cumsum(box, 0)])


@pytest.mark.parametrize("overlap", [0.5, 0.25])
def test_scans_with_their_own_tiles_in_one_job(spark, overlap):
    """Thin, small and larger frames and tiles that follow from them, one scan with most of all voxels, blocks that fit nothing."""
    rng = np.random.default_rng(4)
    shapes = {1: (3, 20, 9), 2: (25, 18, 21), 3: (4, 4, 4), 4: (7, 30, 8)}
    boxes = {i: rng.integers(-1000, 1000, n).astype(np.float32) for i, n in shapes.items()}
    rows = [(i, *map(int, p), float(v)) for i, b in boxes.items() for p, v in np.ndenumerate(b) for p in [p]]
    scans = spark.createDataFrame([(i, nx, ny, nz) for i, (nz, ny, nx) in shapes.items()], "scan_id long, nx int, ny int, nz int")
    fitted = tiling.fit_tile(scans, (8, 12, 12), (2, 4, 4))
    table = spark.createDataFrame([(i, z, y, x, v) for i, z, y, x, v in rows], "scan_id long, z int, y int, x int, hu float")
    out = flows.score_volumes(table.repartition(5), fitted, place_scorer, None, 3, overlap, block=7)
    got = {i: np.full((3, *n), np.nan) for i, n in shapes.items()}
    for r in blocks.voxels_of(out, "logit", 3).collect():
        got[r.scan_id][:, r.z, r.y, r.x] = r.logit
    for r in fitted.collect():
        assert np.allclose(got[r.scan_id], plain_blend(boxes[r.scan_id], (r.tz, r.ty, r.tx), place_scorer, overlap), rtol=1e-6)
    labels = blocks.voxels_of(blocks.argmax_blocks(out, 3), "label").collect()
    assert all(r.label == got[r.scan_id][:, r.z, r.y, r.x].argmax() for r in labels) and len(labels) == len(rows)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_smoothing_does_not_depend_on_blocks(spark, block):
    """Reach beyond a block and beyond the frame, another spacing on each axis, against a plain padded filter."""
    rng = np.random.default_rng(3)
    box, spacing, sigma = rng.integers(-1000, 1000, (9, 7, 4)).astype(np.float32), (0.3, 0.5, 1.0), 0.6
    rows = [(*p, v) for p, v in zip([tuple(map(int, i)) for i in np.ndindex(box.shape)], box.ravel().tolist())]
    frame = heads(spark, (4, 7, 9), spacing)
    out = halo.gaussian_blocks(blocks.to_blocks(voxels(spark, rows, "hu float"), frame, block), frame, sigma, block)
    got = np.full(box.shape, np.nan)
    for r in blocks.voxels_of(out, "hu").collect():
        got[r.z, r.y, r.x] = r.hu
    want = box.astype(float)
    for axis, s in enumerate(spacing[::-1]):
        k = math.ceil(3 * sigma / s)
        w = np.exp(-(np.arange(-k, k + 1) * s) ** 2 / (2 * sigma ** 2))
        pad = np.pad(want, [(k, k) if a == axis else (0, 0) for a in range(3)], mode="edge")
        want = np.apply_along_axis(lambda v: np.convolve(v, w / w.sum(), "valid"), axis, pad)
    assert np.allclose(got, want, rtol=1e-9)


def test_no_row_per_voxel_is_shuffled(spark):
    cells = [(z, y, x, 1.0) for z, y, x in itertools.product(range(12), repeat=3)]
    out = flows.score_volumes(voxels(spark, cells, "hu float"), heads(spark, (12, 12, 12)), lambda b: np.stack([b, b]), (6, 6, 6), 2, block=6)
    rows = out.collect()
    assert len(rows) == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(scan_id" in plan and " z#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_blocks_on_disk(spark, tmp_path):
    rows = [(s, z, y, x, float(z * 100 + y * 10 + x + s)) for s in (1, 2, 3) for z, y, x in itertools.product(range(9), range(7), range(5))]
    table = spark.createDataFrame(rows, "scan_id long, z int, y int, x int, hu float")
    made = blocks.to_blocks(table, heads(spark, (5, 7, 9), scans=(1, 2, 3)), 4)
    volumes.write_blocks(made, f"{tmp_path}/b", 2)
    back = volumes.read_blocks(spark, f"{tmp_path}/b")
    assert sorted(map(tuple, blocks.voxels_of(back, "hu").collect())) == sorted(rows)
    some = volumes.read_blocks(spark, f"{tmp_path}/b", [2], [(3, 4), (0, 4), (4, 9)])
    assert sorted((r.scan_id, r.z0, r.y0, r.x0) for r in some.collect()) == [(2, 0, 0, 4)]
    volumes.write_volumes(table, f"{tmp_path}/v", 2)
    packed = blocks.to_blocks(volumes.read_volumes(spark, f"{tmp_path}/v", [2]), heads(spark, (5, 7, 9), scans=(2,)), 4)
    assert sorted(map(tuple, blocks.voxels_of(packed, "hu").collect())) == sorted(r for r in rows if r[0] == 2)


def test_a_missing_or_repeated_voxel_is_an_error(spark):
    cells = [(z, y, x, 1.0) for z, y, x in itertools.product(range(4), repeat=3)]
    for wrong, say in ((cells[1:], "63 of 64"), (cells + cells[:1], "65 of 64"), (cells[1:] + cells[-1:], "repeated")):
        with pytest.raises(PythonException, match=say):
            blocks.to_blocks(voxels(spark, wrong, "hu float"), heads(spark, (4, 4, 4))).collect()
    assert blocks.to_blocks(voxels(spark, cells, "hu float").limit(0), heads(spark, (4, 4, 4))).count() == 0


def test_failing_tile_names_itself(spark):
    cells = [(z, y, x, 1.0) for z, y, x in itertools.product(range(4), repeat=3)]
    frame = heads(spark, (4, 4, 4), scans=(77,))
    cut = blocks.tile_pieces(blocks.to_blocks(voxels(spark, cells, "hu float", scan=77), frame), frame, (4, 4, 4))
    def broken(_box):
        raise MemoryError("out of memory")
    with pytest.raises(PythonException, match="scan 77, tile at z0 y0 x0"):
        blocks.score_tiles(cut, broken).collect()
    with pytest.raises(PythonException, match="scorer returned shape"):
        blocks.score_tiles(cut, lambda b: b).collect()


def test_crop_holds_the_box(spark):
    scans = heads(spark, (40, 40, 40), (0.5, 0.5, 0.5), (3.0, -2.0, 7.0), [0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1])
    lo, hi = np.array([2.0, 8.0, 10.0]), np.array([6.0, 3.0, 15.0])
    r = G.crop_ranges(scans.withColumns({"box_lo": F.array(*map(F.lit, lo)), "box_hi": F.array(*map(F.lit, hi))})).first()
    d = np.array([0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1]).reshape(3, 3)
    for c in itertools.product(*zip(lo, hi)):
        i = d.T @ (np.array(c) - [3.0, -2.0, 7.0]) / 0.5
        for v, a, b in zip(i, (r.ax, r.ay, r.az), (r.bx, r.by, r.bz)):
            assert a - 0.5 <= max(v, -0.5) and min(v, 39.5) <= b - 0.5 + 1e-9


def test_otsu_split_matches_brute_force():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 40)
    def between(i, j):
        out = 0.0
        for s in (slice(0, i + 1), slice(i + 1, j + 1), slice(j + 1, 40)):
            w = h[s].sum()
            if w:
                out += (h[s] * np.arange(40)[s]).sum() ** 2 / w
        return out
    best = max((between(i, j), -i, -j) for i in range(38) for j in range(i + 1, 39))
    assert histogram.best_split(h) == (-best[1], -best[2])


def test_dice_bounds_and_symmetry(spark):
    a = voxels(spark, [(0, 0, x, 1) for x in range(6)] + [(1, 0, 0, 2)])
    b = voxels(spark, [(0, 0, x, 1) for x in range(3, 9)])
    one = {r.class_id: r for r in measure.dice(a, b, b).collect()}
    two = {r.class_id: r for r in measure.dice(b, a, a).collect()}
    assert one[1].ours == two[1].ours == pytest.approx(0.5)
    assert one[2].ours == 0.0 and math.isnan(one[2].agreement) and two[2].ours is None


def test_sound_canal_is_left_alone(spark):
    jaw = [(z, y, x, 1) for z in range(3) for y in range(14) for x in range(14)]
    canals = [(5, y, x, 5) for y in range(2, 12) for x in (2, 11)]
    scans = heads(spark, (16, 16, 16), (6.0, 6.0, 6.0))
    labels = voxels(spark, jaw + canals)
    assert canal.canal_health(labels, scans).first().reasons == []
    def never(_box):
        raise AssertionError("scored")
    out = flows.refine_canal(labels, scans, never, (4, 4, 4), 6, source=(None, None))
    assert out.count() == labels.count()
    with pytest.raises(ValueError, match="unknown mode"):
        flows.refine_canal(labels, scans, never, (4, 4, 4), 6, mode="finer")


def test_no_mandible_is_a_reason(spark):
    out = canal.canal_health(voxels(spark, [(0, 0, 0, 2)]), heads(spark, scans=(1, 2))).collect()
    assert [r.reasons for r in out] == [["no mandible"], ["no mandible"]]


def test_second_pass_never_shrinks_a_canal(spark):
    labels = voxels(spark, [(0, 0, x, 5) for x in range(5)] + [(0, 1, 0, 3)])
    scans = heads(spark, spacing=(6.0, 6.0, 6.0))
    worse = spark.createDataFrame([(1, 0, 0, 0)], "scan_id long, z int, y int, x int")
    better = spark.createDataFrame([(1, 0, y, x) for y in (0, 1) for x in range(5)], "scan_id long, z int, y int, x int")
    assert canal.merge_second_pass(labels, worse, scans).filter("label = 5").count() == 5
    out = canal.merge_second_pass(labels, better, scans)
    assert out.filter("label = 5").count() == 9 and out.filter("label = 3").count() == 1


def test_salted_join_equals_broadcast_join(spark, monkeypatch):
    rows = spark.range(500).selectExpr("id % 3 AS scan_id", "cast(id % 7 AS int) AS z", "cast(id % 5 AS int) AS y", "id")
    facts = spark.createDataFrame([(0, "a"), (1, "b")], "scan_id long, f string")
    want = sorted(map(tuple, A.attach(rows, facts, how="left").select("id", "f").collect()), key=str)
    monkeypatch.setattr(A, "BROADCAST_BYTES", 0)
    got = A.attach(rows, facts, how="left")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("id", "f").collect()), key=str) == want


@pytest.mark.parametrize("ranged", [False, True])
def test_ordered_scans_equal_windows(spark, ranged):
    df = spark.range(300).selectExpr("id % 2 AS k", "id AS seq", "case when id % 7 = 0 then id end AS v", "id % 5 AS n")
    b = None if ranged else F.floor(F.col("seq") / 16)
    got = ordered.carry_last(df, ["k"], b, ["seq"], {"last": F.col("v")})
    got = ordered.running_sum(got, ["k"], b, ["seq"], {"sum": F.col("n")})
    got = ordered.number_rows(got, ["k"], b, ["seq"], "rn")
    got = ordered.next_value(got, ["k"], b, ["seq"], {"nx": F.col("v")})
    got.createOrReplaceTempView("got")
    w = "(PARTITION BY k ORDER BY seq)"
    bad = spark.sql(f"""SELECT * FROM (SELECT *, last_value(v) IGNORE NULLS OVER {w} a, sum(n) OVER {w} b,
        row_number() OVER {w} c, lead(v) OVER {w} d FROM got) WHERE NOT (a <=> last AND b = sum AND c = rn AND d <=> nx)""")
    assert bad.isEmpty()


def test_manifest_and_checksums_of_real_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.DCM").write_bytes(b"1")
    (tmp_path / "b.nii.gz").write_bytes(b"22")
    (tmp_path / "c.zip").write_bytes(b"333")
    (tmp_path / "IM000001").write_bytes(b"4444")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.length) for r in manifest.scan_manifest(spark, str(tmp_path)).collect()}
    assert got == {"a.DCM": ("volume", 1), "b.nii.gz": ("volume", 2), "c.zip": ("archive", 3), "IM000001": ("other", 4)}
    import hashlib
    want = spark.createDataFrame([("x", "c.zip", hashlib.sha256(b"333").hexdigest())], "archive string, name string, expected string")
    _, verdict = config.checksum_audit(config.checksum_files(spark, str(tmp_path), "x"), want)
    assert verdict.first().accepted
    (tmp_path / "m.json").write_text('{"spacing": 0.3,\n "normalization": {"clip": [-1000, 3492]}}')
    assert config.read_config(spark, str(tmp_path / "m.json")).first().normalization.clip == [-1000, 3492]


@pytest.mark.parametrize("files,series,want", [
    (["a/1.dcm"], [("a", "s")], ("series", "a")),
    (["b/x.mha", "a/y.nrrd"], [], ("volume", "a/y.nrrd")),
    (["one.zip"], [], ("archive", "one.zip")),
    (["one.zip", "two.zip"], [], ("error", manifest.NO_INPUT)),
    (["deep/one.zip"], [], ("error", manifest.NO_INPUT)),
    (["notes.txt"], [], ("error", manifest.NO_INPUT)),
    (["notes.txt", "z/v.MHD"], [], ("volume", "z/v.MHD")),
])
def test_input_forms(spark, files, series, want):
    m = spark.createDataFrame([(1, f) for f in files], "root long, path string")
    s = spark.createDataFrame([(1, d, u) for d, u in series], "root long, dir string, series_uid string")
    out = manifest.resolve_input(m, s).collect()
    assert [(r.how, r.path) for r in out] == [want]


def test_longest_series_wins_over_scout(spark):
    rows = [(1, "scout", "u1", i) for i in range(3)] + [(1, "deep/ct", "u2", i) for i in range(24)]
    s = manifest.select_series(spark.createDataFrame(rows, "root long, dir string, series_uid string, instance long"))
    assert s.first().series_uid == "u2" and s.first().slices == 24
    sizes = manifest.series_sizes(spark.createDataFrame(rows, "root long, dir string, series_uid string, instance long"))
    v = spark.createDataFrame([(1, 1, "", 1), (2, 9, "", 1), (3, 1, "", 50), (4, 1, "scout", 1), (5, 1, "deep", 1), (6, 1, "de", 1)],
                              "volume_id long, root long, folder string, depth int")
    out = {r.volume_id: (r.status, r.slices) for r in manifest.promote_single_slice(v, sizes).collect()}
    assert out == {1: ("series", 24), 2: ("error", None), 3: ("volume", 50), 4: ("series", 3), 5: ("series", 24), 6: ("error", None)}


def test_anisotropic_and_fine_frames_keep_their_field_of_view(spark):
    g = G.grid_plan(heads(spark, (32, 32, 20), (0.3, 0.3, 0.9))).first()
    assert (g.gx, g.gy, g.gz) == (32, 32, 60)
    g = G.grid_plan(heads(spark, (32, 32, 24), (0.15, 0.15, 0.15))).first()
    for n, m in zip((32, 32, 24), (g.gx, g.gy, g.gz)):
        assert abs(n * 0.15 - m * 0.3) <= 0.31


def test_pseudonyms_with_nested_folders(spark):
    paths = ["a-b/x.DCM", "a/y.nii.gz", "a/deep/../w/ж.жж", "top", "a/w/v.txt"]
    m = spark.createDataFrame([(1, p) for p in paths], "root long, path string")
    got = {r.path: r.new_path for r in manifest.pseudonymise_paths(m).collect()}
    assert got == {"a-b/x.DCM": "d001/f000001.DCM", "a/deep/../w/ж.жж": "d002/d001/d001/f000002",
                   "a/w/v.txt": "d002/d002/f000003.txt", "a/y.nii.gz": "d002/f000004.nii.gz", "top": "f000005"}


def test_preview_that_was_cleaned_up(spark, tmp_path):
    with pytest.raises(RuntimeError, match="build the preview again"):
        preview.preview_mask(spark, str(tmp_path / "nothing"))


def test_volume_table_prunes_by_scan(spark, tmp_path):
    df = spark.range(40).selectExpr("id % 10 AS scan_id", "cast(id AS int) AS z", "0 AS y", "0 AS x", "cast(1 AS short) AS label")
    volumes.write_volumes(df, str(tmp_path / "v"), buckets=8)
    out = volumes.read_volumes(spark, str(tmp_path / "v"), scan_ids=[3, 4], z_range=(0, 20), buckets=8)
    assert sorted((r.scan_id, r.z) for r in out.collect()) == [(3, 3), (3, 13), (4, 4), (4, 14)]
    known = volumes.read_volumes(spark, str(tmp_path / "v"), scan_ids=[3])             # written with 8, not with the default
    assert sorted(r.z for r in known.collect()) == [3, 13, 23, 33]
    with pytest.raises(ValueError, match="8 buckets"):
        volumes.read_volumes(spark, str(tmp_path / "v"), scan_ids=[3], buckets=4)
    assert "PartitionFilters: [isnotnull(bucket" in out._jdf.queryExecution().toString() or "bucket" in \
        out._jdf.queryExecution().executedPlan().toString()


def test_private_words_beat_the_allow_list_and_stay_hidden(spark):
    lines = spark.createDataFrame([(1, None, "by Dr. Example, secretword"), (2, "x/post_op/y", "fine"), (3, "a.py", "AUTHORS = [")],
                                  "line_id long, path string, line string")
    rows = [(r.line_id, r.part, r.snippet) for r in guard.guard_text(lines, ["SecretW"]).orderBy("line_id").collect()]
    assert rows == [(1, "text", "(not shown)"), (2, "path", "x/post_op/y")]


def test_fine_pass_restores_the_missing_side_only(spark):
    jaw = [(z, y, x, 1) for z in range(3) for y in range(14) for x in range(14)]
    left = [(5, y, 2, 5) for y in range(2, 12)]
    right = {(4, y, 11) for y in range(2, 12)}
    scans = heads(spark, (16, 16, 16), (6.0, 6.0, 6.0))
    hu = [(z, y, x, 1087.0 if (z, y, x) in right else -1000.0) for z, y, x in itertools.product(range(16), repeat=3)]
    def scorer(box):
        out = np.zeros((6, *box.shape), np.float32)
        out[5] = 0.4 - np.abs(box - 0.4)
        return out
    out = flows.refine_canal(voxels(spark, jaw + left), scans, scorer, (8, 8, 8), 6, spacing=6.0, margin_mm=12.0,
                             source=(voxels(spark, hu, "hu float"), scans))
    got = {(r.z, r.y, r.x, r.label) for r in out.collect()}
    assert got == set(jaw) | set(left) | {(*p, 5) for p in right}


# --- runs ------------------------------------------------------------------------------------------------------------------------

LINES = ["reading: scan.mha", "resampled to LPS", "computing on: GPU", "tile 1/8", "tile 8/8", "surfaces prepared", "Mandible: 1 cm3", "Canal: 2 cm3",
         "separating teeth", "tile 1/2", "upper arch: 3", "tile 2/2", "lower arch: 4", "canal looks broken", "noise", "done in 5 s", ""]


def plain_progress(lines, n_classes=9):
    """The gauge over (seq, line) in order."""
    import re

    from voxelspark.functions import progress as P
    from voxelspark.streaming.progress import Gauge
    gauge, out = Gauge((None, None, 0, 0, None), n_classes, P.MESH), []
    for seq, line in sorted(lines):
        s = line.strip()
        tile, marks = re.match(P.TILE, s), {"reading:": "reading", "resampled to": "resampled", "computing on:": "computing", "surfaces prepared": "surfaces",
                                            "separating teeth": "separating", "done in": "done", "canal looks broken": "canal"}
        event = next((e for m, e in marks.items() if s.startswith(m)), None) or ("tile" if tile else "arch" if re.match(P.ARCH_LINE, s) else
                                                                                 "mesh" if re.match(P.MESH_LINE, s) else None)
        out.append(gauge.feed(seq, event, int(tile[1]) / max(1, int(tile[2])) if tile else None))
    return out


@pytest.mark.parametrize("rows", [1, 3, 16, 1000])
def test_run_summaries_compose_over_blocks(spark, rows):
    """Whatever the blocks are, random line orders give what one pass over the run gives."""
    rnd = random.Random(rows)
    runs_ = {r: [(i, rnd.choice(LINES)) for i in range(rnd.randint(1, 90))] for r in range(25)}
    runs_[25] = [(i, LINES[i % len(LINES)]) for i in range(400)]
    df = spark.createDataFrame([(r, i, t) for r, ts in runs_.items() for i, t in ts], "run_id long, seq long, line string")
    got = {}
    for r in runs.run_progress(df.repartition(4), bucket_rows=rows).collect():
        got.setdefault(r.run_id, []).append((r.seq, r.phase, r.factor))
    for r, lines in runs_.items():
        for g, w in zip(sorted(got[r]), plain_progress(lines), strict=True):
            assert g[:2] == w[:2] and g[2] == (w[2] if w[2] is None else pytest.approx(w[2]))


def test_stream_state_ends_with_the_run(spark, tmp_path):
    """Lines in disorder, over three starts of the query; a run that is done leaves nothing, one that is silent is given up."""
    from voxelspark.streaming.progress import run_progress_stream
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    whole = [(i, LINES[i]) for i in range(16)]
    parts = [[(1, *x) for x in whole[:7]] + [(2, *x) for x in whole[:4]], [(1, *x) for x in reversed(whole[7:])] + [(3, 0, LINES[0])], [(4, 5, LINES[2]), (4, 3, LINES[0])]]
    try:
        for n, part in enumerate(parts):
            spark.createDataFrame(part, "run_id long, seq long, line string").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
            lines = spark.readStream.schema("run_id long, seq long, line string").parquet(f"{tmp_path}/in")
            stream = run_progress_stream(lines, idle_seconds=3600 if n < 2 else 0)
            q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
            q.awaitTermination()
            left = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "gauge").load()
            assert sorted(r["k"] for r in left.selectExpr("key.run_id AS k").collect()) == [[1, 2], [2, 3], [2, 3]][n]       # 1 is done, 4 has no time to be silent
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r.run_id, []).append((r.seq, r.phase, r.factor))
    assert sorted(got[1]) == plain_progress(whole) and sorted(got[2]) == plain_progress(whole[:4]) and sorted(got[4]) == plain_progress([(3, LINES[0]), (5, LINES[2])])



def _shuffled(spark, run) -> int:
    """Bytes that ``run`` writes to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
    before = total()
    run()
    return total() - before


def test_scores_of_resampled_blocks_are_those_of_the_single_steps(spark):
    from voxelspark.functions import intensity as I
    from voxelspark.operators import regions, resample

    def bands(box):
        return np.stack([0.06 * c - np.abs(box + 2.0 - c / 2) for c in range(5)]).astype(np.float32)

    rng = np.random.default_rng(7)
    head = heads(spark, (9, 7, 13), (0.7, 1.0, 0.4)).unionByName(heads(spark, (1, 3, 2), (0.4, 0.3, 0.3), scans=(2,)))
    rows = voxels(spark, [(z, y, x, float(rng.integers(-1000, 2000))) for z in range(13) for y in range(7) for x in range(9)], "hu float").unionByName(
        voxels(spark, [(z, y, x, float(rng.integers(-1000, 2000))) for z in range(2) for y in range(3) for x in range(1)], "hu float", scan=2))
    grid = resample.resampled_headers(head)
    assert regions.suits((4, 3, 4), 0.5, 16) and not regions.suits((160, 320, 320))
    out = {}
    def fused():
        got = regions.resampled_scores(blocks.to_blocks(rows, head, 16), head, grid, I.normalized, bands, (4, 3, 4), 5, block=16, labels=False)
        out["fused"] = {(r.scan_id, r.z0, r.y0, r.x0): r.logit for r in got.collect()}
    def single():
        ready = resample.resample_linear(rows, head).withColumn("hu", I.normalize_ct(F.col("hu")).cast("float"))
        out["single"] = {(r.scan_id, r.z0, r.y0, r.x0): r.logit for r in flows.score_volumes(ready, grid, bands, (4, 3, 4), 5, block=16).collect()}
    small, large = _shuffled(spark, fused), _shuffled(spark, single)
    assert out["fused"] == out["single"] and len(out["fused"]) > 8
    assert 10 * small < large
    label = regions.resampled_scores(blocks.to_blocks(rows, head, 16), head, grid, I.normalized, bands, (4, 3, 4), 5, block=16).collect()
    assert all(r.label == np.reshape(out["fused"][r.scan_id, r.z0, r.y0, r.x0], (-1, 5)).argmax(1).tolist() for r in label)


@pytest.mark.parametrize("block", [3, 8, 64])
def test_components_of_label_blocks(spark, block):
    rng = np.random.default_rng(block)
    box = rng.integers(0, 3, (13, 8, 10)).astype(np.int16)
    box[:, 4, 2:9] = 2
    rows = voxels(spark, [(*map(int, p), int(box[tuple(p)])) for p in np.argwhere(box > 0)])
    cut = [(1, z, y, x, list(map(int, c.shape)), c.ravel().tolist()) for z in range(0, 13, block) for y in range(0, 8, block)
           for x in range(0, 10, block) for c in [box[z:z + block, y:y + block, x:x + block]]]
    dense = spark.createDataFrame(cut, "scan_id long, z0 int, y0 int, x0 int, shape array<int>, label array<short>")
    want, got = C.connected_components(rows, block=5), C.components_of_blocks(dense, block)
    assert sorted(map(tuple, got.sizes().collect())) == sorted(map(tuple, want.sizes().collect()))
    each = lambda p: sorted(map(tuple, p.join(p.sizes().select(*p.keys, "comp")).select("label", "z", "y", "x", "comp").collect()))
    assert each(got) == each(want)


def test_resampling_shuffles_the_source_and_not_the_grid(spark):
    from voxelspark.operators import resample
    rng = np.random.default_rng(3)
    rows = voxels(spark, [(z, y, x, float(rng.normal())) for z in range(17) for y in range(12) for x in range(12)], "hu double").cache()
    head = heads(spark, (12, 12, 17), (1.2, 1.2, 1.2))
    source = _shuffled(spark, lambda: rows.repartition("scan_id", "z").count() and rows.repartition("scan_id", "z").write.format("noop").mode("overwrite").save())
    grid = _shuffled(spark, lambda: resample.resample_linear(rows, head).write.format("noop").mode("overwrite").save())
    assert grid < 3 * source


def test_no_formula_is_worked_out_twice_or_by_lambdas(spark):
    from suites.fixtures import Fixtures
    from voxelspark.operators import tiles
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()       # noqa: E731
    assert plan(fx.labels.filter("label in (3, 4)")).count("CASE WHEN") == plan(fx.labels).count("CASE WHEN")
    for df in (fx.logits, tiles.tile_voxels(fx.voxels, fx.scans, (8, 8, 8)), surface.iso_vertices(fx.voxels, fx.scans, 400.0)):
        assert "lambda" not in plan(df)


def test_quantiles_of_keys_of_any_size(spark, monkeypatch):
    """Keys of few values are sorted whole (one table of counts is written); larger ones beside them are selected."""
    from voxelspark.operators import quantiles as Q
    rng = random.Random(11)
    values = {k: [rng.choice((rng.uniform(-5, 5), 0.0, -0.0, 2.5)) for _ in range(n)] for k, n in ((1, 1), (2, 7), (3, 400), (4, 900))}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(2, None), (3, float("nan")), (None, 1.0), (5, None)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5).cache()
    levels = [0.0, 0.1, 0.5, 0.995, 1.0]
    want = {(k, i): np.quantile(vs, q) for k, vs in values.items() for i, q in enumerate(levels)}
    written = []
    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda x: written.append(x) or cut(x))
    for few, ends, most in ((Q.FEW, None, 1), (Q.FEW, Q.extents(df, ["k"], "v"), 0), (100, None, 9), (100, Q.extents(df.filter("k > 0"), ["k"], "v"), 9), (0, None, 9)):
        written.clear()
        got = {(r.k, r.level): r.value for r in Q.quantiles(df, ["k"], "v", levels, ends=ends, few=few).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        assert len(written) <= most


def test_blocks_are_labelled_some_at_a_time(monkeypatch):
    """What is held of a batch does not grow with the blocks in it, and roots are those of each block for itself."""
    import pandas as pd
    from voxelspark.operators import components as C
    rng = np.random.default_rng(5)
    each = [rng.choice(512, 300, replace=False).astype(np.int32) for _ in range(3000)]
    sizes, label = [], C.local_roots
    monkeypatch.setattr(C, "local_roots", lambda pos, *rest: sizes.append(len(pos)) or label(pos, *rest))
    got = C.roots_of_blocks(pd.Series(each), 8, C.half_offsets(6))
    assert sum(sizes) == 900_000 and max(sizes) <= 64 ** 3 + 512
    for i in (0, 871, 872, 873, 874, 1500, 2999):
        assert (got[i] == label(each[i], np.zeros(300, int), 8, C.half_offsets(6))).all()


def test_voxels_are_packed_before_python(spark):
    """One pass through Python, of arrays: a row per plane of a block, not per voxel."""
    cells = {(z, y, x): float(z * 100 + y * 10 + x) for z in range(5) for y in range(7) for x in range(9)}
    rows = [(*at, v) for at, v in cells.items()]
    made = blocks.to_blocks(voxels(spark, rows, "hu float").repartition(3), heads(spark, (9, 7, 5)), 4)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for r in made.collect():
        box = np.array(r.hu).reshape(r.shape)
        assert all(v == cells[r.z0 + z, r.y0 + y, r.x0 + x] for (z, y, x), v in np.ndenumerate(box))


def test_blocks_resampled_as_rows(spark):
    """Blocks of a resampled grid hold the values of ``resample_linear``, across block borders and beyond the last voxel."""
    from voxelspark.operators import regions, resample
    rng = random.Random(3)
    cells = {(z, y, x): rng.uniform(-1000, 3000) for z in range(6) for y in range(7) for x in range(9)}
    scans = heads(spark, (9, 7, 6)).withColumn("spacing", F.array(F.lit(0.4), F.lit(1.5), F.lit(0.9)))
    source = blocks.to_blocks(voxels(spark, [(*at, v) for at, v in cells.items()], "hu float"), scans, 4)
    rows = blocks.voxels_of(source, "hu")
    for spacing in (1.0, 0.7):
        got = {(r.z, r.y, r.x): r.hu for r in blocks.voxels_of(regions.resampled_blocks(source, scans, spacing, 4), "hu").collect()}
        want = {(r.z, r.y, r.x): r.hu for r in resample.resample_linear(rows, scans, spacing).collect()}
        assert got == want


def test_scores_are_not_shuffled(spark):
    """Regions give what tiles give one by one, for frames over several regions and frames thinner than a tile; only the source moves."""
    rng = np.random.default_rng(5)
    shapes = {1: (13, 7, 9), 2: (3, 2, 9)}
    scans = heads(spark, (9, 7, 13), scans=(1,)).unionByName(heads(spark, (9, 2, 3), scans=(2,)))
    rows = None
    for k, shape in shapes.items():
        own = voxels(spark, [(*map(int, p), float(v)) for p, v in np.ndenumerate(rng.integers(-1000, 3000, shape)) for p in [p]], "hu float", scan=k)
        rows = own if rows is None else rows.unionByName(own)
    made = blocks.to_blocks(rows, scans, 4).cache()
    made.count()

    def score(key, box):
        return np.stack([box * (c + 1) + key[1] + key[3] for c in range(3)])
    got, tile = {}, (4, 3, 4)
    def whole():
        got["region"] = {tuple(r[:4]): (r.shape, r.logit) for r in blocks.blend_regions(made, scans, score, tile, 3, block=4).collect()}
    def single():
        pieces = blocks.tile_pieces(made, scans, tile)
        got["tile"] = {tuple(r[:4]): (r.shape, r.logit) for r in blocks.blend_tiles(blocks.map_tiles(pieces, score, 4), 3, 4).collect()}
    small, large = _shuffled(spark, whole), _shuffled(spark, single)
    assert got["region"] == got["tile"] and len(got["region"]) == 4 * 2 * 3 + 3
    assert 4 * small < large
    assert blocks.region_edge(4) == 64 and blocks.region_edge(6) == 60 and blocks.region_edge(100) == 100
    edge, spread, blocks.REGION, blocks.SPREAD = blocks.REGION, blocks.SPREAD, 8, 0          # several regions a frame
    try:
        whole()
        assert got["region"] == got["tile"]
        blocks.REGION = edge
        own = scans.selectExpr("*", "4 AS tz", "3 AS ty", "4 AS tx", "0.5D AS overlap")
        each = blocks.blended(made, own, score, None, 3, None, block=4)
        assert {tuple(r[:4]): (r.shape, r.logit) for r in each.collect()} == got["tile"]
        assert blocks._by_region(own, None, None, 3, 4) and not blocks._by_region(scans, (160, 320, 320), 0.5, 3, 4)
    finally:
        blocks.REGION, blocks.SPREAD = edge, spread


def test_places_of_whole_planes_are_not_shuffled(spark):
    cells = [(z, y, x, float((z * 31 + y * 17 + x) % 50)) for z, y, x in itertools.product(range(40), range(30), range(30))]
    rows, frame = voxels(spark, cells, "hu float").coalesce(1).cache(), heads(spark, (30, 30, 40))
    out = {}
    def made(name, df):
        out[name] = sorted(map(tuple, blocks.to_blocks(df, frame, 16).collect()))
    rows.count()
    mixed = rows.orderBy(F.xxhash64("z", "y", "x")).coalesce(1).cache()
    mixed.count()
    plane = rows.repartition("scan_id", "z").sortWithinPartitions("z", "y", "x").cache()
    plane.count()
    ordered, other = _shuffled(spark, lambda: made("ordered", plane)), _shuffled(spark, lambda: made("mixed", mixed))
    assert out["ordered"] == out["mixed"] and 3 * ordered < other


def test_few_blocks_are_read_at_once(spark, tmp_path):
    """A reader's batch of 4,096 blocks would be gigabytes; it ends with the row group."""
    import pyarrow.parquet as pq
    rows = [(s, z, y, x, float(x)) for s in range(40) for z, y, x in itertools.product(range(3), repeat=3)]
    table, scans = spark.createDataFrame(rows, "scan_id long, z int, y int, x int, hu float"), heads(spark, (3, 3, 3), scans=tuple(range(40)))
    _, labels, grid = flows.segment_blocks(table, scans, lambda b: np.stack([b, -b]), (2, 2, 2), 2)
    made = blocks.to_blocks(table, scans, 4)
    volumes.write_blocks(made.coalesce(1), f"{tmp_path}/b", 1)
    for df in (labels, spark.read.parquet(f"{tmp_path}/b")):
        sizes = [m.row_group(i).num_rows for f in df.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
        assert sum(sizes) == 40 and max(sizes) <= 16


def test_preview_shuffles_blocks_and_little_else(spark, tmp_path):
    """The coarse grid by one shuffle of the source, written as blocks, its top quantile from the values near it: the same values."""
    from voxelspark.operators import histogram, quantiles, regions
    rng = np.random.default_rng(11)
    rows = None
    for k, shape in {1: (13, 10, 17), 2: (5, 3, 9)}.items():
        own = voxels(spark, [(*map(int, p), float(v)) for p, v in np.ndenumerate(rng.integers(-1000, 2000, shape))], "hu float", scan=k)
        rows = own if rows is None else rows.unionByName(own)
    scans = heads(spark, (17, 10, 13), (0.9, 0.4, 1.3), scans=(1,)).unionByName(heads(spark, (9, 3, 5), scans=(2,)))
    rows = rows.cache()
    rows.count()
    out = {}
    def plain():
        smooth = halo.gaussian_blocks(blocks.to_blocks(rows, scans, 8), scans, 0.6, 8)
        out["two"] = sorted(map(tuple, regions.resampled_blocks(smooth, scans, 0.7, 8).collect()))
    def whole():
        out["one"] = sorted(map(tuple, regions.resampled_blocks(blocks.to_blocks(rows, scans, 8), scans, 0.7, 8, smooth=halo.gaussian(0.6)).collect()))
    large, small = _shuffled(spark, plain), _shuffled(spark, whole)
    assert out["one"] == out["two"] and len(out["one"]) > 8 and small < large
    coarse, levels = flows.preview_grid(rows, scans, 0.7, 0.6, 8)
    assert sorted(map(tuple, coarse.collect())) == out["two"]
    each = blocks.voxels_of(coarse, "hu").cache()
    inside = histogram.inside_fov(each)
    top = {r.scan_id: r.value for r in quantiles.quantiles(inside, ["scan_id"], "hu", [histogram.TOP_FRACTION]).collect()}
    few, got = histogram.FEW, sorted(map(tuple, levels.collect()))
    assert [r[3] for r in got] == [max(top[r[0]], r[2] + 1.0) for r in got] and any(r[3] == top[r[0]] for r in got)
    try:
        histogram.FEW = 3                                # one scan has more values in the bin and above
        assert sorted(map(tuple, histogram.otsu_thresholds(inside).collect())) == got
    finally:
        histogram.FEW = few
    small = _shuffled(spark, lambda: preview.save_preview(coarse, levels.limit(0), f"{tmp_path}/blocks"))
    large = _shuffled(spark, lambda: preview.save_preview(each, levels.limit(0), f"{tmp_path}/rows"))
    a, b = (sorted(map(tuple, volumes.read_volumes(spark, f"{tmp_path}/{d}/grid").select("scan_id", "z", "y", "x", "hu").collect())) for d in ("blocks", "rows"))
    assert a == b and len(a) == each.count()
    assert 3 * small < large

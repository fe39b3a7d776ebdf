"""Volumes as array blocks: one row per block of voxels, not per voxel.

A block row holds ``scan_id``, the block's first voxel ``z0, y0, x0``, its ``shape`` (z, y, x;
cut off at the frame's end) and one array of values in z, y, x order (per voxel all classes
for logits). Tiles are put together from whole blocks and the parts of neighbours that reach
into them; scored tiles are cut along block borders again and blended by adding arrays. What is
shuffled are arrays of bounded size, keyed by tile or block, never a row per voxel. A scan that
holds a third of all voxels is a third of all blocks, spread like any others. Where tiles are well
below a region of blocks (``suits``), they are scored and blended in it, and no score is shuffled.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.tiling import OVERLAP, SIGMA_SCALE, WEIGHT_FLOOR
from voxelspark.plans.attach import attach
from voxelspark.session import grid_partitions

BLOCK = 64
BLOCK_KEYS = ["scan_id", "z0", "y0", "x0"]
TILE_KEYS = ["scan_id", "tz", "ty", "tx"]
#: ``meta``: frame, tile, place and shape, three 32-bit integers each
_PIECES = "scan_id long, tz int, ty int, tx int, meta binary, data binary"
_SCORED = "scan_id long, z0 int, y0 int, x0 int, tz int, ty int, tx int, meta binary, data binary"
Scorer = Callable[[np.ndarray], np.ndarray]


class TileError(RuntimeError):
    """A scorer failed on one tile; nothing is replaced or skipped."""


# --- rows and blocks -------------------------------------------------------------------------------------------------------------

def to_blocks(voxels: DataFrame, scans: DataFrame, block: int = BLOCK, value: str = "hu") -> DataFrame:
    """Blocks of a dense table with a row per voxel.

    Each task collects what it has of a block's plane, so voxels go to Python as arrays. Places are sent only of planes
    that are not whole and in order. A frame with missing or repeated voxels is an error."""
    def merge(batches):
        keys, shapes, values, held_now = [], [], [], 0
        for t in _whole_runs(batches, BLOCK_KEYS):
            key = np.stack([t.column(k).to_numpy() for k in BLOCK_KEYS], 1)
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]).tolist()
            held = {c: (np.asarray(t.column(c).offsets), t.column(c).values.to_numpy(zero_copy_only=False)) for c in ("at", "data")}
            plane, placed = t.column("plane").to_numpy(), t.column("at").is_valid().to_numpy(zero_copy_only=False)
            for i, j in zip(first, [*first[1:], len(key)], strict=True):
                where = tuple(key[i].tolist())
                shape = [min(block, n - o) for n, o in zip(t.column("frame")[i].as_py(), where[1:], strict=True)]
                size = shape[0] * shape[1] * shape[2]
                (o, flat), (d, data) = held["at"], held["data"]
                depth = plane[i:j] - where[1]
                order = np.argsort(depth)
                if not placed[i:j].any() and depth[order].tolist() == list(range(shape[0])):
                    box = data[d[i]:d[j]].reshape(shape[0], -1)[order].ravel()
                else:
                    lines = (np.arange(shape[1])[:, None] * block + np.arange(shape[2])).ravel()
                    at = np.concatenate([flat[o[k]:o[k + 1]] if placed[k] else lines for k in range(i, j)])
                    own, z = data[d[i]:d[j]], np.repeat(depth, np.diff(d[i:j + 1]))
                    place = [z, at // block, at % block]
                    if len(at) != size or len(own) != size or any((p >= n).any() for p, n in zip(place, shape, strict=True)):
                        raise ValueError(f"scan {where[0]}, block at z{where[1]} y{where[2]} x{where[3]}: {len(at)} of {size} voxels present")
                    to = (place[0] * shape[1] + place[1]) * shape[2] + place[2]
                    box, filled = np.empty(size, np.float32), np.zeros(size, bool)
                    box[to], filled[to] = own, True
                    if not filled.all():
                        raise ValueError(f"scan {where[0]}, block at z{where[1]} y{where[2]} x{where[3]}: repeated voxels")
                keys.append(where)
                shapes.append(shape)
                values.append(box)
                held_now += size
                if held_now >= AT_ONCE // 16:
                    yield _block_rows(keys, shapes, values, value, pa.float32())
                    keys, shapes, values, held_now = [], [], [], 0
        if keys:
            yield _block_rows(keys, shapes, values, value, pa.float32())

    corner = [(F.floor(F.col(a) / block).cast("int") * block).alias(f"{a}0") for a in "zyx"]
    y, x = (F.pmod(F.col(a), F.lit(block)) for a in "yx")
    rows = voxels.select("scan_id", F.col("z").alias("plane"), *corner, (y * block + x).cast("int").alias("at"),
                         F.coalesce(F.col(value).cast("float"), F.lit(float("nan"))).alias("data"))
    packed = rows.groupBy("scan_id", "plane", *BLOCK_KEYS[1:]).agg(F.collect_list("at").alias("at"), F.collect_list("data").alias("data"))
    frame = scans.select("scan_id", F.array("nz", "ny", "nx").alias("frame"))
    packed = attach(packed, frame, sized_by=scans, salt_by=("z0", "y0"))
    ny, nx = (F.least(F.lit(block), F.col("frame")[i] - F.col(c)) for i, c in ((1, "y0"), (2, "x0")))
    lines = F.transform(F.sequence(F.lit(0), ny - 1), lambda i: F.sequence(i * block, i * block + nx - 1))
    whole = (ny > 0) & (nx > 0) & (F.size("at") == ny * nx)
    packed = packed.withColumn("at", F.when(~whole | (F.col("at") != F.flatten(F.when(whole, lines))), F.col("at")))
    return _dealt(packed, BLOCK_KEYS).mapInArrow(merge, f"scan_id long, z0 int, y0 int, x0 int, shape array<int>, {value} array<float>")


def voxels_of(blocks: DataFrame, value: str, classes: int | None = None) -> DataFrame:
    """A row per voxel: ``scan_id, z, y, x`` and the value (with ``classes``, the array of the voxel's values)."""
    n = F.col("shape")
    own = F.col("_own")
    if classes is None:
        each = blocks.select(*BLOCK_KEYS, "shape", F.posexplode(value).alias("_i", "_own"))
    else:
        each = blocks.select(*BLOCK_KEYS, "shape", value, F.explode(F.sequence(F.lit(0), n[0] * n[1] * n[2] - 1)).alias("_i"))
        own = F.slice(value, F.col("_i") * classes + 1, F.lit(classes))
    i, plane = F.col("_i"), n[1] * n[2]
    z, y, x = (F.call_function("div", i, plane), F.call_function("div", i, n[2]) % n[1], i % n[2])
    return each.select("scan_id", *[(F.col(f"{a}0") + p).cast("int").alias(a) for a, p in zip("zyx", (z, y, x), strict=True)], own.alias(value))


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list per row of a matrix."""
    n, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(values.ravel(), kind))


def _blocks_alike(scan: np.ndarray, corner: Sequence[int], shape: Sequence[int], values: np.ndarray, name: str, kind: pa.DataType) -> pa.RecordBatch:
    """Block rows of one place and shape, a scan each."""
    n = len(scan)
    cols = [pa.array(scan, pa.int64()), *[pa.repeat(pa.scalar(o, pa.int32()), n) for o in corner],
            pa.array([[int(s) for s in shape]] * n, pa.list_(pa.int32())), _lists(values.reshape(n, -1), kind)]
    return pa.RecordBatch.from_arrays(cols, [*BLOCK_KEYS, "shape", name])


def _block_rows(keys, shapes, values, name, kind) -> pa.RecordBatch:
    flat = np.concatenate(values)
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    cols = [pa.array([k[0] for k in keys], pa.int64()), *[pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2, 3)],
            pa.array([[int(n) for n in s] for s in shapes], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))]
    return pa.RecordBatch.from_arrays(cols, [*BLOCK_KEYS, "shape", name])


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of a key together and in order. Tasks are as many as set, not coalesced by bytes: they are all computation."""
    return df.repartition(grid_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)


def _runs(batches, keys: Sequence[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Key and rows of each run of equal keys, over batch borders; one run is held at a time."""
    now, rows = None, []
    for b in batches:
        for at in range(0, b.num_rows, 16):              # values of a whole batch are not held twice
            for r in b.slice(at, 16).to_pylist():
                if r.get("meta"):
                    meta = np.frombuffer(r["meta"], np.int32).tolist()
                    r |= {"frame": meta[:3], "tile": meta[3:6], "at": meta[6:9], "shape": meta[9:]}
                key = tuple(r[k] for k in keys)
                if key != now:
                    if rows:
                        yield now, rows
                    now, rows = key, []
                rows.append(r)
    if rows:
        yield now, rows


def _whole_runs(batches, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a run of equal keys does."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(k).to_numpy() for k in keys], 1)
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
        if rest and any(rest[-1].column(k)[-1].as_py() != v for k, v in zip(keys, at[0].tolist(), strict=True)):
            yield pa.concat_batches(rest)
            rest = []
        if first[-1]:
            yield pa.concat_batches([*rest, b.slice(0, first[-1])])
            rest = []
        rest.append(b.slice(first[-1]))
    if rest:
        yield pa.concat_batches(rest)


# --- tiles -----------------------------------------------------------------------------------------------------------------------

def _starts(n: int, tile: int, overlap: float) -> list[int]:
    """Window starts along an axis: regular steps, and one flush with the end."""
    last = max(n, tile) - tile
    step = max(1, round(tile * (1 - overlap)))
    return [*range(0, last, step), last]


def with_tile(scans: DataFrame, tile: Sequence[int] | None = None, overlap: float | None = OVERLAP) -> DataFrame:
    """``scan_id, frame, tile, overlap``: each scan's own where not given (columns of ``fit_tile``; ``overlap``)."""
    own = F.array("tz", "ty", "tx") if tile is None else F.array(*[F.lit(int(t)) for t in tile])
    part = F.col("overlap") if overlap is None else F.lit(float(overlap))
    return scans.select("scan_id", F.array("nz", "ny", "nx").cast("array<int>").alias("frame"), own.cast("array<int>").alias("tile"),
                        part.cast("double").alias("overlap"))


def tile_pieces(blocks: DataFrame, scans: DataFrame, tile: Sequence[int] | None = None, overlap: float | None = OVERLAP, value: str = "hu",
                channels: int = 1) -> DataFrame:
    """What each block gives to each tile that covers some of it: place in the tile, shape and values.

    Tiles follow from arithmetic on the frame and the scan's tile size; there is no join with a tile list."""
    def cut(batches):
        for b in batches:
            for r, scan, boxes in _alike(b, value, channels):
                corner = [r["z0"], r["y0"], r["x0"]]
                covers = []
                for n, t, o, s in zip(r["frame"], r["tile"], corner, r["shape"], strict=True):
                    covers.append([(w, max(w, o), min(w + t, o + s)) for w in _starts(n, t, r["overlap"]) if w < o + s and w + t > o])
                for z in covers[0]:
                    for y in covers[1]:
                        for x in covers[2]:
                            own = boxes[(slice(None), *[slice(a - o, e - o) for (_, a, e), o in zip((z, y, x), corner, strict=True)])]
                            meta = _meta(r["frame"], r["tile"], [w[1] - w[0] for w in (z, y, x)], own.shape[1:4])
                            yield _same(scan, [z[0], y[0], x[0], meta], own, _PIECE_SCHEMA)
    held = attach(blocks.select(*BLOCK_KEYS, "shape", value), with_tile(scans, tile, overlap), sized_by=scans, salt_by=("z0", "y0"))
    return held.mapInArrow(cut, _PIECES)


_INTS = pa.list_(pa.int32())
_PLACE = [("scan_id", pa.int64()), ("tz", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32())]
_PIECE_SCHEMA = pa.schema([*_PLACE, ("meta", pa.binary()), ("data", pa.binary())])
_SCORED_SCHEMA = pa.schema([_PLACE[0], *[(c, pa.int32()) for c in ("z0", "y0", "x0")], *_PLACE[1:], ("meta", pa.binary()), ("data", pa.binary())])


def _meta(frame, tile, at, shape) -> bytes:
    return np.array([*frame, *tile, *at, *shape], np.int32).tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch, value: str) -> Iterator[dict]:
    """Rows of block tables, the values as arrays."""
    values = batch.column(value)
    plain = batch.drop_columns([value]).to_pylist()
    at = np.asarray(values.offsets)
    flat = values.values.to_numpy(zero_copy_only=False)
    for i, r in enumerate(plain):
        yield r | {value: flat[at[i]:at[i + 1]]}


AT_ONCE = 1 << 22               # values of blocks or tiles that are worked on together


def _alike(batch: pa.RecordBatch, value: str, channels: int = 1) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Rows of block tables that differ in scan and values only, together: the first, scans and values (row, z, y, x, channel)."""
    rest = batch.drop_columns([value, "scan_id"])
    scan = batch.column("scan_id").to_numpy()
    values = batch.column(value)
    at, flat = np.asarray(values.offsets), values.values.to_numpy(zero_copy_only=False)
    kinds: dict = {}
    for i, r in enumerate(zip(*[rest.column(c).to_pylist() for c in rest.schema.names], strict=True)):
        kinds.setdefault(tuple(tuple(v) if isinstance(v, list) else v for v in r), []).append(i)
    for kind, rows in kinds.items():
        r = {c: list(v) if isinstance(v, tuple) else v for c, v in zip(rest.schema.names, kind, strict=True)}
        size = int(np.prod(r["shape"])) * channels
        if (at[np.array(rows) + 1] - at[rows] != size).any():
            raise ValueError(f"a block of shape {r['shape']} holds another number of values")
        step = max(1, AT_ONCE // size)
        for k in range(0, len(rows), step):
            some = np.array(rows[k:k + step])
            own = flat[at[some[0]]:at[some[0]] + size][None] if len(some) == 1 else flat[at[some][:, None] + np.arange(size)]
            yield r, scan[some], own.reshape(-1, *r["shape"], channels)


def _same(scan: np.ndarray, facts: list, values: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A row per scan with the same facts and each its own values."""
    n = len(scan)
    data = np.ascontiguousarray(values, np.float32)
    size = data.nbytes // n
    cols = [pa.array(scan, pa.int64()), *[pa.repeat(pa.scalar(v, f.type), n) for v, f in zip(facts, list(schema)[1:-1], strict=True)],
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(data)])]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _runs_alike(batches, keys: Sequence[str], order: Sequence[str] = ()) -> Iterator[tuple[np.ndarray, list[dict]]]:
    """Runs of equal keys over batch borders; those whose pieces differ in scan and values only, together.

    Gives the scans and, for each piece of the runs, the first one's facts and ``data``, a row of values per run. Of what does
    not fit ``AT_ONCE``, one run is worked on at a time."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(k).to_numpy() for k in keys], 1)
        new = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
        if rest and any(rest[-1].column(k)[-1].as_py() != v for k, v in zip(keys, at[0].tolist(), strict=True)):
            yield from _by_pattern(rest, keys, order)
            rest = []
        if len(new):
            yield from _by_pattern([*rest, b.slice(0, new[-1])], keys, order)
            rest = [b.slice(new[-1])]
        else:
            rest.append(b)
    if rest:
        yield from _by_pattern(rest, keys, order)


def _by_pattern(parts: list[pa.RecordBatch], keys: Sequence[str], order: Sequence[str]) -> Iterator[tuple[np.ndarray, list[dict]]]:
    t = pa.Table.from_batches(parts)
    facts = [c for c in t.column_names if pa.types.is_binary(t.schema.field(c).type) and c != "data"]
    scan = t.column("scan_id").to_numpy()
    at = np.stack([t.column(k).to_numpy() for k in keys], 1)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
    kind = np.stack([*[t.column(c).to_numpy() for c in (*keys[1:], *order)],
                     *[t.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in facts]], 1).astype(np.int32)
    runs: dict = {}
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        runs.setdefault(kind[i:j].tobytes(), []).append((i, j))
    chunks = [(np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4), np.frombuffer(c.buffers()[2] or b"", np.uint8)) for c in t.column("data").chunks]
    part = np.repeat(np.arange(len(chunks)), [len(o) - 1 for o, _ in chunks])
    begin = np.concatenate([o[:-1] for o, _ in chunks]).astype(np.int64)
    size = np.concatenate([np.diff(o) for o, _ in chunks])

    def values(rows: np.ndarray) -> np.ndarray:
        own = [np.frombuffer(chunks[part[i]][1][begin[i]:begin[i] + size[i]], np.float32) for i in rows.tolist()]
        return own[0][None] if len(own) == 1 else np.stack(own)

    for same in runs.values():
        i, j = same[0]
        pieces = []
        for k in range(i, j):
            r = {c: t.column(c)[k].as_py() for c in (*keys, *order, *facts)}
            meta = np.frombuffer(r["meta"], np.int32).tolist()
            pieces.append(r | {"frame": meta[:3], "tile": meta[3:6], "at": meta[6:9], "shape": meta[9:]})
        step = max(1, AT_ONCE * 4 // max(1, int(size[i:j].sum())))
        starts = np.array([s for s, _ in same])
        for k in range(0, len(same), step):
            some = starts[k:k + step]
            yield scan[some], [r | {"data": values(some + n)} for n, r in enumerate(pieces)]


def _boxes(rows: list[dict], channels: int) -> np.ndarray:
    """Tiles from their pieces; beyond a frame thinner than the tile its last voxels are repeated."""
    tile, frame = rows[0]["tile"], rows[0]["frame"]
    there = [min(t, n) for t, n in zip(tile, frame, strict=True)]
    box = np.empty((len(rows[0]["data"]), *there, channels), np.float32)
    filled = 0
    for r in rows:
        box[(slice(None), *[slice(a, a + s) for a, s in zip(r["at"], r["shape"], strict=True)])] = r["data"].reshape(-1, *r["shape"], channels)
        filled += int(np.prod(r["shape"]))
    if filled != np.prod(there):
        raise ValueError(f"{filled} of {np.prod(there)} voxels present")
    if there != tile:
        box = np.pad(box, [(0, 0), *[(0, t - n) for t, n in zip(tile, there, strict=True)], (0, 0)], mode="edge")
    return box


def assemble_tiles(pieces: DataFrame) -> DataFrame:
    """Whole tiles: ``scan_id, tz, ty, tx, tile`` and ``hu``, their values in z, y, x order."""
    def run(batches):
        for scan, rows in _runs_alike(batches, TILE_KEYS):
            box, n = _boxes(rows, 1), len(scan)
            place = [pa.repeat(pa.scalar(rows[0][k], pa.int32()), n) for k in TILE_KEYS[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(scan, pa.int64()), *place, pa.array([rows[0]["tile"]] * n, _INTS), _lists(box.reshape(n, -1), pa.float32())],
                                             [*TILE_KEYS, "tile", "hu"])
    return _dealt(pieces, TILE_KEYS).mapInArrow(run, "scan_id long, tz int, ty int, tx int, tile array<int>, hu array<float>")


def _failed(scan, start, tile, e: Exception) -> TileError:
    return TileError(f"scan {int(scan)}, tile at z{start[0]} y{start[1]} x{start[2]}, shape {tuple(tile)}: {e}")


def _scored(fn: Callable[[tuple, np.ndarray], np.ndarray], scan: np.ndarray, start: tuple, boxes: np.ndarray, tile: list[int], channels: int) -> np.ndarray:
    """``fn`` of one tile of several scans: (scan, z, y, x, class)."""
    outs = []
    for own, box in zip(scan.tolist(), boxes, strict=True):
        try:
            out = np.asarray(fn((own, *start), box[..., 0] if channels == 1 else box), np.float32)
            if list(out.shape[1:]) != tile:
                raise ValueError(f"scorer returned shape {out.shape}")
        except Exception as e:
            raise _failed(own, start, tile, e) from e
        outs.append(out)
    return np.moveaxis(np.stack(outs), 1, -1)


def map_tiles(pieces: DataFrame, fn: Callable[[tuple, np.ndarray], np.ndarray], block: int = BLOCK, channels: int = 1) -> DataFrame:
    """Run ``fn(key, tile)`` on every tile and cut its (classes, z, y, x) result along block borders, padding dropped.

    The tile is float32, (z, y, x), or (z, y, x, channels) for blocks with several values a voxel. A failing tile
    fails the job and says which tile of which scan it was."""
    def run(batches):
        for scan, rows in _runs_alike(batches, TILE_KEYS):
            tile, frame = rows[0]["tile"], rows[0]["frame"]
            start = tuple(rows[0][k] for k in TILE_KEYS[1:])
            try:
                boxes = _boxes(rows, channels)
            except Exception as e:
                raise _failed(scan[0], start, tile, e) from e
            out = _scored(fn, scan, start, boxes, tile, channels)
            spans = [[(o, max(w, o), min(w + t, o + block, n)) for o in range(w // block * block, min(w + t, n), block)]
                     for w, t, n in zip(start, tile, frame, strict=True)]
            for z in spans[0]:
                for y in spans[1]:
                    for x in spans[2]:
                        own = out[(slice(None), *[slice(a - w, e - w) for (_, a, e), w in zip((z, y, x), start, strict=True)])]
                        meta = _meta(frame, tile, [s[1] - s[0] for s in (z, y, x)], own.shape[1:4])
                        yield _same(scan, [z[0], y[0], x[0], *start, meta], own, _SCORED_SCHEMA)
    return _dealt(pieces, TILE_KEYS).mapInArrow(run, _SCORED)


def score_tiles(pieces: DataFrame, score: Scorer, block: int = BLOCK) -> DataFrame:
    """Run a user's scorer on every tile: float32 array (z, y, x) in, (classes, z, y, x) out."""
    return map_tiles(pieces, lambda _, box: score(box), block)


def bell(tile: Sequence[int], sigma_scale: float = SIGMA_SCALE) -> np.ndarray:
    """Separable bell over a tile, relative to its largest sampled value, floored."""
    weight = np.ones(1)
    for n in tile:
        off = np.arange(n) - (n - 1) / 2
        axis = np.exp(-off * off / (2 * max(n * sigma_scale, 1e-6) ** 2))
        weight = weight[..., None] * (axis / axis.max())
    return np.maximum(weight[0], WEIGHT_FLOOR)


def blend_tiles(scored: DataFrame, num_classes: int, block: int = BLOCK, weight: Callable[[Sequence[int]], np.ndarray] = bell) -> DataFrame:
    """Blocks of logits: the weighted mean of the overlapping tiles per voxel and class.

    A block is the sum of at most the tiles that cover some of it, added in the order of their starts."""
    def run(batches):
        known: dict = {}
        for scan, rows in _runs_alike(batches, BLOCK_KEYS, TILE_KEYS[1:]):
            corner = [rows[0][k] for k in BLOCK_KEYS[1:]]
            shape = [min(block, n - o) for n, o in zip(rows[0]["frame"], corner, strict=True)]
            total, mass = np.zeros((len(scan), *shape, num_classes)), np.zeros((*shape, 1))
            for r in rows:
                tile, size = tuple(r["tile"]), r["shape"]
                if tile not in known:
                    known = {tile: weight(tile)[..., None]}
                own = r["data"].reshape(len(scan), *size, -1)
                if own.shape[-1] != num_classes:
                    raise ValueError(f"{own.shape[-1]} classes, not {num_classes}")
                inside = [o + a - w for o, a, w in zip(corner, r["at"], (r["tz"], r["ty"], r["tx"]), strict=True)]
                w = known[tile][tuple(slice(a, a + s) for a, s in zip(inside, size, strict=True))]
                here = tuple(slice(a, a + s) for a, s in zip(r["at"], size, strict=True))
                total[(slice(None), *here)] += w * own
                mass[here] += w
            yield _blocks_alike(scan, corner, shape, total / np.maximum(mass, 1e-6), "logit", pa.float64())
    dealt = _dealt(scored, BLOCK_KEYS, ["tz", "ty", "tx"])
    return dealt.mapInArrow(run, "scan_id long, z0 int, y0 int, x0 int, shape array<int>, logit array<double>")


def argmax_blocks(logits: DataFrame, num_classes: int, value: str = "logit") -> DataFrame:
    """Blocks of labels: the class with the largest logit, the lowest on ties."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                flat = b.column(value)
                at = np.asarray(flat.offsets) // num_classes
                best = flat.values.to_numpy(zero_copy_only=False)[at[0] * num_classes:at[-1] * num_classes].reshape(-1, num_classes).argmax(1)
                label = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(best.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in (*BLOCK_KEYS, "shape")] + [label], [*BLOCK_KEYS, "shape", "label"])
    return logits.select(*BLOCK_KEYS, "shape", value).mapInArrow(run, "scan_id long, z0 int, y0 int, x0 int, shape array<int>, label array<short>")


# --- regions ---------------------------------------------------------------------------------------------------------------------

REGION = 64                     # edge of what is scored and blended in one task, in whole blocks
MOST_TWICE = 2.0                # tiles scored for each that there is, on the average
SPREAD = 1 << 26                # bytes of all scores that are shuffled rather than worked out by regions
_REGION_PIECES = "scan_id long, z0 int, y0 int, x0 int, meta binary, step binary, data binary"
_REGION_SCHEMA = pa.schema([_PLACE[0], *[(c, pa.int32()) for c in ("z0", "y0", "x0")], ("meta", pa.binary()), ("step", pa.binary()), ("data", pa.binary())])


def suits(tile: Sequence[int], overlap: float = OVERLAP, block: int = BLOCK) -> bool:
    """True where scoring a tile in every block it reaches costs at most ``MOST_TWICE`` the scores."""
    return prod((block + t) / block for t in tile) <= MOST_TWICE


def region_edge(block: int = BLOCK) -> int:
    return block * max(1, REGION // block)


def _by_region(scans: DataFrame, tile: Sequence[int] | None, overlap: float | None, num_classes: int, block: int) -> bool:
    """Whether every tile suits a region and scores are more than ``SPREAD`` bytes.

    Fewer are better spread, as then a tile is what a task works on and not a region of them. One pass over the headers."""
    edge = region_edge(block)
    if tile is not None and not suits(tile, block=edge):
        return False
    n, t = F.col("frame"), F.col("tile")
    cost = prod(((t[i] + edge) / edge for i in range(3)), start=F.lit(1.0))
    each = prod((F.greatest(n[i], t[i]) / F.greatest(1 - F.col("overlap"), 1 / t[i]) for i in range(3)), start=F.lit(4.0 * num_classes))
    most, total = with_tile(scans, tile, overlap).agg(F.max(cost), F.sum(each)).first()
    return most is not None and most <= MOST_TWICE and total > SPREAD


@lru_cache(4096)
def _regions(n: int, tile: int, overlap: float, edge: int) -> list[tuple[int, list[int], int, int]]:
    """Along an axis of n voxels, for each region: start, tiles that reach it, first and last voxel of these."""
    out = []
    for o in range(0, n, edge):
        own = [w for w in _starts(n, tile, overlap) if w < o + edge and w + tile > o]
        out.append((o, own, min(own), min(max(own) + tile, n)))
    return out


def blend_regions(blocks: DataFrame, scans: DataFrame, fn: Callable[[tuple, np.ndarray], np.ndarray], tile: Sequence[int] | None, num_classes: int,
                  overlap: float | None = OVERLAP, block: int = BLOCK, value: str = "hu", channels: int = 1,
                  weight: Callable[[Sequence[int]], np.ndarray] = bell) -> DataFrame:
    """What ``tile_pieces``, ``map_tiles`` and ``blend_tiles`` give one after the other, a region of blocks in one task.

    Parts of source blocks are shuffled, each to the regions whose tiles reach it; scores are not. A tile that reaches
    several regions is worked out in each, so this is for tiles well below a region (``suits``)."""
    edge = region_edge(block)

    def cut(batches):
        for b in batches:
            for r, scan, boxes in _alike(b, value, channels):
                corner, reach = [r["z0"], r["y0"], r["x0"]], []
                for n, t, c, s in zip(r["frame"], r["tile"], corner, r["shape"], strict=True):
                    reach.append([(o, low, max(low, c), min(high, c + s)) for o, _, low, high in _regions(n, t, r["overlap"], edge) if low < c + s and high > c])
                part = np.array([r["overlap"]]).tobytes()
                for z, y, x in product(*reach):
                    own = boxes[(slice(None), *[slice(a - c, e - c) for (_, _, a, e), c in zip((z, y, x), corner, strict=True)])]
                    meta = _meta(r["frame"], r["tile"], [w[2] - w[1] for w in (z, y, x)], own.shape[1:4])
                    yield _same(scan, [z[0], y[0], x[0], meta, part], own, _REGION_SCHEMA)

    def run(batches):
        known: dict = {}
        for scan, rows in _runs_alike(batches, BLOCK_KEYS):
            corner, frame, tile = [rows[0][k] for k in BLOCK_KEYS[1:]], rows[0]["frame"], rows[0]["tile"]
            part = float(np.frombuffer(rows[0]["step"])[0])
            own = [_regions(n, t, part, edge)[o // edge] for n, t, o in zip(frame, tile, corner, strict=True)]
            box = np.empty((len(scan), *[high - low for *_, low, high in own], channels), np.float32)
            filled = 0
            for r in rows:
                box[(slice(None), *[slice(a, a + s) for a, s in zip(r["at"], r["shape"], strict=True)])] = r["data"].reshape(len(scan), *r["shape"], channels)
                filled += prod(r["shape"])
            if filled != prod(box.shape[1:4]):
                raise ValueError(f"scan {scan[0]}, region at z{corner[0]} y{corner[1]} x{corner[2]}: {filled} of {prod(box.shape[1:4])} voxels present")
            pad = [(0, max(0, max(starts) + t - high)) for (_, starts, _, high), t in zip(own, tile, strict=True)]
            if any(p for _, p in pad):                   # a frame thinner than the tile: its last voxels are repeated
                box = np.pad(box, [(0, 0), *pad, (0, 0)], mode="edge")
            if tuple(tile) not in known:
                known = {tuple(tile): weight(tuple(tile))[..., None]}
            shape = [min(edge, n - o) for n, o in zip(frame, corner, strict=True)]
            some = max(1, AT_ONCE // (prod(shape) * num_classes))
            for i in range(0, len(scan), some):
                ids = scan[i:i + some]
                total, mass = np.zeros((len(ids), *shape, num_classes)), np.zeros((*shape, 1))
                for start in product(*[starts for _, starts, _, _ in own]):
                    at = tuple(slice(w - low, w - low + t) for w, (_, _, low, _), t in zip(start, own, tile, strict=True))
                    out = _scored(fn, ids, start, box[(slice(i, i + some), *at)], tile, channels)
                    if out.shape[-1] != num_classes:
                        raise ValueError(f"{out.shape[-1]} classes, not {num_classes}")
                    ends = [(max(w, o), min(w + t, o + s)) for w, t, o, s in zip(start, tile, corner, shape, strict=True)]
                    inside = tuple(slice(a - w, e - w) for (a, e), w in zip(ends, start, strict=True))
                    here = tuple(slice(a - o, e - o) for (a, e), o in zip(ends, corner, strict=True))
                    w = known[tuple(tile)][inside]
                    total[(slice(None), *here)] += w * out[(slice(None), *inside)]
                    mass[here] += w
                total /= np.maximum(mass, 1e-6)
                for place in product(*[range(o, o + s, block) for o, s in zip(corner, shape, strict=True)]):
                    here = tuple(slice(p - o, min(p - o + block, s)) for p, o, s in zip(place, corner, shape, strict=True))
                    size = [s.stop - s.start for s in here]
                    yield _blocks_alike(ids, place, size, total[(slice(None), *here)], "logit", pa.float64())

    held = attach(blocks.select(*BLOCK_KEYS, "shape", value), with_tile(scans, tile, overlap), sized_by=scans, salt_by=("z0", "y0"))
    dealt = _dealt(held.mapInArrow(cut, _REGION_PIECES), BLOCK_KEYS, ["meta"])
    return dealt.mapInArrow(run, "scan_id long, z0 int, y0 int, x0 int, shape array<int>, logit array<double>")


def blended(blocks: DataFrame, scans: DataFrame, fn: Callable[[tuple, np.ndarray], np.ndarray], tile: Sequence[int] | None, num_classes: int,
            overlap: float | None = OVERLAP, block: int = BLOCK, value: str = "hu", channels: int = 1,
            weight: Callable[[Sequence[int]], np.ndarray] = bell) -> DataFrame:
    """Run ``fn(key, tile)`` on every tile and blend: blocks of logits. By regions (``_by_region``), else tile by tile."""
    if _by_region(scans, tile, overlap, num_classes, block):
        return blend_regions(blocks, scans, fn, tile, num_classes, overlap, block, value, channels, weight)
    pieces = tile_pieces(blocks, scans, tile, overlap, value, channels)
    return blend_tiles(map_tiles(pieces, fn, block, channels), num_classes, block, weight)


def score_blocks(blocks: DataFrame, scans: DataFrame, score: Scorer, tile: Sequence[int] | None, num_classes: int,
                 overlap: float | None = OVERLAP, block: int = BLOCK, value: str = "hu") -> DataFrame:
    """Cut, score and blend every scan: blocks of logits on the scans' frames.

    Without ``tile`` or ``overlap``, each scan has its own (``fit_tile``), all in one job."""
    return blended(blocks, scans, lambda _, box: score(box), tile, num_classes, overlap, block, value)

"""Resample, score and blend a block of the finer grid in one task, from the source voxels it needs.

A finer grid has many times the source's voxels and a score for each class of each of them; here
neither is shuffled. What moves are parts of source blocks: each to the blocks of the grid whose
tiles reach it. A tile that reaches several blocks is scored in each of them, so this is for tiles
well below a block (``suits``); larger ones go through ``blocks``.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.geometry import GRID_SPACING_MM, SIZE
from voxelspark.functions.tiling import OVERLAP
from voxelspark.operators.blocks import AT_ONCE, BLOCK, BLOCK_KEYS, TileError, _alike, _batch, _block_rows, _blocks_alike, _dealt, _meta, _rows, _runs, _runs_alike, _same, _starts, bell, suits  # noqa: F401
from voxelspark.operators.resample import OUTSIDE_HU, resampled_headers
from voxelspark.plans.attach import attach

_PIECES = "scan_id long, z0 int, y0 int, x0 int, meta binary, step binary, data binary"
_SCHEMA = pa.schema([("scan_id", pa.int64()), ("z0", pa.int32()), ("y0", pa.int32()), ("x0", pa.int32()),
                     ("meta", pa.binary()), ("step", pa.binary()), ("data", pa.binary())])


def _axis(n: int, step: float, m: int, spacing: float, tile: int, overlap: float, block: int) -> list[tuple[int, list[int], int, int, int, int]]:
    """Along an axis of n voxels, for each block of its grid of m: start, tiles, first and last place in reach, source range."""
    out = []
    for o in range(0, m, block):
        own = [w for w in _starts(m, tile, overlap) if w < min(o + block, m) and w + tile > o]
        low, high = min(own), min(max(own) + tile, m)
        first = min(int(np.floor(low * spacing / step)), n - 1)
        out.append((o, own, low, high, first, min(int(np.floor((high - 1) * spacing / step)) + 2, n)))
    return out


def _linear(box: np.ndarray, axis: int, first: int, n: int, step: float, low: int, high: int, spacing: float) -> np.ndarray:
    """Places low to high of the grid along one axis of a box that begins at voxel ``first`` of n; as ``resample_linear``."""
    p = np.arange(low, high) * spacing / step
    at = np.minimum(np.floor(p).astype(np.int64), n - 1)
    box = np.moveaxis(box, axis, -1)
    here, there = box[..., at - first], box[..., np.minimum(at + 1, n - 1) - first]
    out = here + (there - here) * (p - np.floor(p))
    last = at == n - 1
    out[..., last] = here[..., last]
    out[..., p >= n - 0.5] = OUTSIDE_HU
    return np.moveaxis(out, -1, axis)


def resampled_blocks(blocks: DataFrame, scans: DataFrame, spacing: float = GRID_SPACING_MM, block: int = BLOCK, value: str = "hu",
                     smooth: tuple[Callable[[np.ndarray], list[int]], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """Blocks (double) on the isotropic grid of ``resampled_headers``: the values of ``resample_linear``, voxels never rows.

    What is shuffled are parts of source blocks, each to the blocks of the grid whose voxels lie in or next to it. ``smooth`` is
    a reach and a filter (``halo.gaussian``) that goes first, on parts that reach further: what it gives is not shuffled."""
    def reach(step):
        return smooth[0](np.array(step)) if smooth else [0, 0, 0]

    def sources(n, step, m, far):
        """For each block of the grid along an axis: start, end, source range, and the range that this is filtered from."""
        for o in range(0, m, block):
            e = min(o + block, m)
            a, b = min(int(np.floor(o * spacing / step)), n - 1), min(int(np.floor((e - 1) * spacing / step)) + 2, n)
            yield o, e, a, b, max(a - far, 0), min(b + far, n)

    def cut(batches):
        for b in batches:
            for r, scan, boxes in _alike(b, value):
                boxes, corner, step = boxes[..., 0].astype(np.float32 if smooth else float), [r["z0"], r["y0"], r["x0"]], np.array(r["step"])
                each = [[(o, a, max(a, c), min(e, c + k)) for o, _, _, _, a, e in sources(n, s, m, far) if a < c + k and e > c]
                        for n, s, m, far, c, k in zip(r["frame"], r["step"], r["fine"], reach(r["step"]), corner, r["shape"], strict=True)]
                for z in each[0]:
                    for y in each[1]:
                        for x in each[2]:
                            own = boxes[(slice(None), *[slice(a - c, e - c) for (_, _, a, e), c in zip((z, y, x), corner, strict=True)])]
                            meta = _meta(r["frame"], r["fine"], [w[2] - w[1] for w in (z, y, x)], own.shape[1:])
                            yield _same(scan, [z[0], y[0], x[0], meta, step.tobytes()], np.ascontiguousarray(own).view(np.float32), _SCHEMA)

    def run(batches):
        for scan, rows in _runs_alike(batches, BLOCK_KEYS):
            key, frame, fine = [rows[0][k] for k in BLOCK_KEYS], rows[0]["frame"], rows[0]["tile"]
            step = np.frombuffer(rows[0]["step"]).tolist()
            far = reach(step)
            own = [next(s for s in sources(n, d, m, k) if s[0] == o) for n, d, m, k, o in zip(frame, step, fine, far, key[1:], strict=True)]
            box = np.empty([len(scan), *[e - a for *_, a, e in own]], np.float32 if smooth else float)
            filled = 0
            for r in rows:
                data = r["data"] if smooth else np.ascontiguousarray(r["data"]).view(np.float64)         # doubles, sent as pairs of floats
                box[(slice(None), *[slice(a, a + s) for a, s in zip(r["at"], r["shape"], strict=True)])] = data.reshape(-1, *r["shape"])
                filled += prod(r["shape"])
            if filled != prod(box.shape[1:]):
                raise ValueError(f"scan {key[0]}, block at z{key[1]} y{key[2]} x{key[3]}: {filled} of {prod(box.shape[1:])} voxels present")
            shape = [e - o for o, e, *_ in own]
            pad = [(0, 0), *[(k - (a - low), k - (high - b)) for (_, _, a, b, low, high), k in zip(own, far, strict=True)]]
            some = max(1, AT_ONCE // max(prod(shape), prod(n + x + y for n, (x, y) in zip(box.shape[1:], pad[1:], strict=True))))
            for i in range(0, len(scan), some):
                out = box[i:i + some]
                if smooth:
                    out = smooth[1](np.pad(out.astype(float), pad, mode="edge"), np.array(step))
                for axis in (2, 1, 0):
                    low, high, first, *_ = own[axis]
                    out = _linear(out, axis + 1, first, frame[axis], step[axis], low, high, spacing)
                yield _blocks_alike(scan[i:i + some], key[1:], shape, out, value, pa.float64())

    fine = resampled_headers(scans, spacing).select("scan_id", F.array("nz", "ny", "nx").cast("array<int>").alias("fine"))
    s = F.col("spacing")
    facts = scans.select("scan_id", F.array("nz", "ny", "nx").cast("array<int>").alias("frame"), F.array(s[2], s[1], s[0]).alias("step")).join(fine, "scan_id")
    held = attach(blocks.select(*BLOCK_KEYS, "shape", value), facts, sized_by=scans, salt_by=("z0", "y0"))
    return _dealt(held.mapInArrow(cut, _PIECES), BLOCK_KEYS).mapInArrow(
        run, f"scan_id long, z0 int, y0 int, x0 int, shape array<int>, {value} array<double>")


def resampled_scores(blocks: DataFrame, scans: DataFrame, grid: DataFrame, prepare: Callable[[np.ndarray], np.ndarray],
                     score: Callable[[np.ndarray], np.ndarray], tile: Sequence[int], num_classes: int, spacing: float = GRID_SPACING_MM,
                     overlap: float = OVERLAP, block: int = BLOCK, labels: bool = True) -> DataFrame:
    """Blocks of ``label`` (short, background included) on ``grid``, or of ``logit`` (double) if ``labels`` is false.

    ``prepare`` turns resampled values (double) into what the scorer sees. Values, order of addition and
    results are those of ``resample_linear``, ``to_blocks`` and ``score_blocks`` one after the other."""
    tile = [int(t) for t in tile]

    known: dict = {}                             # of the frames a task meets, the last thousand

    def spans(frame, fine, step):
        each = []
        for facts in zip(frame, step, fine, tile, strict=True):
            if facts not in known:
                if len(known) > 1000:
                    known.clear()
                n, s, m, t = facts
                known[facts] = _axis(n, s, m, spacing, t, overlap, block)
            each.append(known[facts])
        return each

    def cut(batches):
        for b in batches:
            for r in _rows(b, "hu"):
                box, corner = r["hu"].reshape(r["shape"]), [r["z0"], r["y0"], r["x0"]]
                reach = [[(o, a, max(a, c), min(e, c + s)) for o, _, _, _, a, e in axis if a < c + s and e > c]
                         for axis, c, s in zip(spans(r["frame"], r["fine"], r["step"]), corner, r["shape"], strict=True)]
                done = []
                for z in reach[0]:
                    for y in reach[1]:
                        for x in reach[2]:
                            own = box[tuple(slice(a - c, e - c) for (_, _, a, e), c in zip((z, y, x), corner, strict=True))]
                            done.append((r["scan_id"], z[0], y[0], x[0], _meta(r["frame"], r["fine"], [s[2] - s[1] for s in (z, y, x)], own.shape),
                                         np.array(r["step"]).tobytes(), np.ascontiguousarray(own, np.float32).tobytes()))
                if done:
                    yield _batch(done, _SCHEMA)

    def run(batches):
        weight = bell(tile)[..., None]
        for key, rows in _runs(batches, BLOCK_KEYS):
            frame, fine, step = rows[0]["frame"], rows[0]["tile"], np.frombuffer(rows[0]["step"]).tolist()
            own = [next(s for s in axis if s[0] == o) for axis, o in zip(spans(frame, fine, step), key[1:], strict=True)]
            box = np.empty([e - a for *_, a, e in own], np.float32)
            filled = 0
            for r in rows:
                box[tuple(slice(a, a + s) for a, s in zip(r["at"], r["shape"], strict=True))] = np.frombuffer(r["data"], np.float32).reshape(r["shape"])
                filled += prod(r["shape"])
            if filled != box.size:
                raise ValueError(f"scan {key[0]}, block at z{key[1]} y{key[2]} x{key[3]}: {filled} of {box.size} voxels present")
            box = box.astype(float)
            for i in (2, 1, 0):
                _, _, low, high, first, _ = own[i]
                box = _linear(box, i, first, frame[i], step[i], low, high, spacing)
            box = np.asarray(prepare(box), np.float32)
            pad = [(0, max(0, low + t - high)) for (_, _, low, high, _, _), t in zip(own, tile, strict=True)]
            box = np.pad(box, pad, mode="edge") if any(p for _, p in pad) else box
            shape = [min(block, m - o) for m, o in zip(fine, key[1:], strict=True)]
            total, mass = np.zeros((*shape, num_classes)), np.zeros((*shape, 1))
            for z in own[0][1]:
                for y in own[1][1]:
                    for x in own[2][1]:
                        start = (z, y, x)
                        at = tuple(slice(w - s[2], w - s[2] + t) for w, s, t in zip(start, own, tile, strict=True))
                        try:
                            out = np.asarray(score(box[at]), np.float32)
                            if list(out.shape) != [num_classes, *tile]:
                                raise ValueError(f"scorer returned shape {out.shape}")
                        except Exception as e:
                            raise TileError(f"scan {key[0]}, tile at z{z} y{y} x{x}, shape {tuple(tile)}: {e}") from e
                        ends = [(max(w, o), min(w + t, o + s)) for w, t, o, s in zip(start, tile, key[1:], shape, strict=True)]
                        inside = tuple(slice(a - w, e - w) for (a, e), w in zip(ends, start, strict=True))
                        here = tuple(slice(a - o, e - o) for (a, e), o in zip(ends, key[1:], strict=True))
                        w = weight[inside]
                        total[here] += w * np.moveaxis(out, 0, -1)[inside]
                        mass[here] += w
            total /= np.maximum(mass, 1e-6)
            if labels:
                yield _block_rows([key], [shape], [total.argmax(-1).ravel().astype(np.int16)], "label", pa.int16())
            else:
                yield _block_rows([key], [shape], [total.ravel()], "logit", pa.float64())

    s = F.col("spacing")
    facts = scans.select("scan_id", F.array("nz", "ny", "nx").cast("array<int>").alias("frame"), F.array(s[2], s[1], s[0]).alias("step")).join(
        grid.select("scan_id", F.array(*[F.col(n) for n in reversed(SIZE)]).cast("array<int>").alias("fine")), "scan_id")
    held = attach(blocks.select(*BLOCK_KEYS, "shape", "hu"), facts, sized_by=scans, salt_by=("z0", "y0"))
    return _dealt(held.mapInArrow(cut, _PIECES), BLOCK_KEYS).mapInArrow(
        run, "scan_id long, z0 int, y0 int, x0 int, shape array<int>, " + ("label array<short>" if labels else "logit array<double>"))

"""Filters over array blocks: every block is filtered with a halo of what its neighbours hold.

A block sends its neighbours the slabs within their reach, so what is shuffled is each block
once and its borders again; the filter itself is vectorised arithmetic on one block and its
halo. Beyond the frame the last voxels are repeated.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.operators.blocks import AT_ONCE, BLOCK, BLOCK_KEYS, _alike, _blocks_alike, _dealt, _meta, _runs_alike, _same
from voxelspark.operators.resample import PREVIEW_SIGMA_MM
from voxelspark.plans.attach import attach

_PIECES = "scan_id long, z0 int, y0 int, x0 int, meta binary, step binary, data binary"
_SCHEMA = pa.schema([("scan_id", pa.int64()), ("z0", pa.int32()), ("y0", pa.int32()), ("x0", pa.int32()),
                     ("meta", pa.binary()), ("step", pa.binary()), ("data", pa.binary())])


def with_halo(blocks: DataFrame, scans: DataFrame, reach: Callable[[np.ndarray], list[int]], fn: Callable[[np.ndarray, np.ndarray], np.ndarray],
              block: int = BLOCK, value: str = "hu") -> DataFrame:
    """``fn(boxes, spacing)`` of blocks with ``reach(spacing)`` voxels more on each side, (block, z, y, x); it returns them without these.

    Blocks come together that differ in scan and values only.     The reach follows from a scan's spacing (z, y, x) and may be larger than a block."""
    def cut(batches):
        for b in batches:
            for r, scan, boxes in _alike(b, value):
                boxes, corner, step = boxes[..., 0], [r["z0"], r["y0"], r["x0"]], np.array(r["step"])
                far = reach(step)
                spans = []
                for n, o, s, k in zip(r["frame"], corner, r["shape"], far, strict=True):
                    targets = range(max(0, o - k) // block * block, min(n, o + s + k), block)
                    spans.append([(t, max(t - k, 0), max(o, t - k), min(o + s, min(t + block, n) + k)) for t in targets])
                for z in spans[0]:
                    for y in spans[1]:
                        for x in spans[2]:
                            if all(a < e for _, _, a, e in (z, y, x)):
                                own = boxes[(slice(None), *[slice(a - o, e - o) for (_, _, a, e), o in zip((z, y, x), corner, strict=True)])]
                                meta = _meta(r["frame"], far, [s[2] - s[1] for s in (z, y, x)], own.shape[1:])
                                yield _same(scan, [z[0], y[0], x[0], meta, step.tobytes()], own, _SCHEMA)

    def run(batches):
        for scan, rows in _runs_alike(batches, BLOCK_KEYS):
            key, frame, far = [rows[0][k] for k in BLOCK_KEYS], rows[0]["frame"], rows[0]["tile"]
            low = [max(o - k, 0) for o, k in zip(key[1:], far, strict=True)]
            ends = [min(o + block, n) for o, n in zip(key[1:], frame, strict=True)]
            high = [min(e + k, n) for e, k, n in zip(ends, far, frame, strict=True)]
            box = np.empty([len(scan), *[b - a for a, b in zip(low, high, strict=True)]], np.float32)
            filled = 0
            for r in rows:
                box[(slice(None), *[slice(a, a + s) for a, s in zip(r["at"], r["shape"], strict=True)])] = r["data"].reshape(-1, *r["shape"])
                filled += math.prod(r["shape"])
            if filled != math.prod(box.shape[1:]):
                raise ValueError(f"scan {key[0]}, block at z{key[1]} y{key[2]} x{key[3]}: {filled} of {math.prod(box.shape[1:])} voxels present")
            pad = [(0, 0), *[(k - (o - a), k - (b - e)) for k, o, a, e, b in zip(far, key[1:], low, ends, high, strict=True)]]
            shape = [e - o for o, e in zip(key[1:], ends, strict=True)]
            some = max(1, AT_ONCE // math.prod(s + 2 * k for s, k in zip(shape, far, strict=True)))
            for i in range(0, len(scan), some):
                out = fn(np.pad(box[i:i + some].astype(float), pad, mode="edge"), np.frombuffer(rows[0]["step"]))
                yield _blocks_alike(scan[i:i + some], key[1:], shape, out, value, pa.float64())

    s = F.col("spacing")
    facts = scans.select("scan_id", F.array("nz", "ny", "nx").cast("array<int>").alias("frame"), F.array(s[2], s[1], s[0]).alias("step"))
    held = attach(blocks.select(*BLOCK_KEYS, "shape", value), facts, sized_by=scans, salt_by=("z0", "y0"))
    return _dealt(held.mapInArrow(cut, _PIECES), BLOCK_KEYS).mapInArrow(
        run, f"scan_id long, z0 int, y0 int, x0 int, shape array<int>, {value} array<double>")


def gaussian(sigma_mm: float = PREVIEW_SIGMA_MM) -> tuple[Callable[[np.ndarray], list[int]], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Reach and filter of a separable Gaussian, truncated at three sigma: same sigma in millimetres on every axis.

    An approximation of a recursive filter with finite support."""
    def reach(step):
        return [math.ceil(3.0 * sigma_mm / s) for s in step.tolist()]

    def smooth(box, step):
        for axis, (s, r) in enumerate(zip(step.tolist(), reach(step), strict=True), 1):
            off = np.arange(-r, r + 1) * s
            weight = np.exp(-off * off / (2.0 * sigma_mm * sigma_mm))
            n = box.shape[axis] - 2 * r
            box = np.moveaxis(box, axis, 0)
            total = weight[0] * box[:n]
            for j in range(1, 2 * r + 1):
                total += weight[j] * box[j:j + n]
            box = np.moveaxis(total / weight.sum(), 0, axis)
        return box
    return reach, smooth


def gaussian_blocks(blocks: DataFrame, scans: DataFrame, sigma_mm: float = PREVIEW_SIGMA_MM, block: int = BLOCK, value: str = "hu") -> DataFrame:
    """``gaussian`` of blocks, edges repeated."""
    return with_halo(blocks, scans, *gaussian(sigma_mm), block, value)

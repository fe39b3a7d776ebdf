"""Connected components in two levels, and what follows from their sizes.

Blocks of at most ``block``^3 voxels are labelled locally; a *node* is one
component inside one block. Only voxels on block faces take part in linking
nodes, and only nodes take part in the iteration. Sizes and boxes are kept per
node, so no step ever groups the voxels of a whole component.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelspark.functions.naming import min_volume
from voxelspark.operators.blocks import _dealt, _rows, _runs
from voxelspark.operators.measure import voxel_cm3
from voxelspark.plans.attach import attach, fits_broadcast, salted_join
from voxelspark.plans.ordered import number_rows
from voxelspark.session import cut_lineage

BLOCK = 64
AT_ONCE = 1 << 18                            # voxels labelled together: one full block (each takes some 200 bytes)
_BITS = 21                                   # per coordinate in a packed position


def half_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each opposite pair of neighbour offsets (z, y, x): 3 for faces, 13 for all 26."""
    if connectivity not in (6, 26):
        raise ValueError(f"connectivity must be 6 or 26, not {connectivity}")
    every = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
    return every if connectivity == 26 else [d for d in every if sum(map(abs, d)) == 1]


def local_roots(pos: np.ndarray, cell: np.ndarray, block: int, offsets: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Smallest position of each voxel's component; ``cell`` numbers the block of each position."""
    volume = block ** 3
    p = cell.astype(np.int64) * volume + pos
    order = np.argsort(p)
    p = p[order]
    at = p % volume
    coord = np.stack([at // (block * block), at // block % block, at % block])
    left, right = [], []
    for d in offsets:
        moved = coord + np.array(d)[:, None]
        inside = np.flatnonzero(((moved >= 0) & (moved < block)).all(0))
        want = p[inside] + (d[0] * block + d[1]) * block + d[2]
        found = np.minimum(np.searchsorted(p, want), len(p) - 1)
        hit = p[found] == want
        left.append(inside[hit])
        right.append(found[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(p))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    out = np.empty(len(p), np.int32)
    out[order] = p[root] % volume
    return out


def roots_of_blocks(blocks: pd.Series, block: int, offsets: Sequence[tuple[int, int, int]],
                    at_once: int = AT_ONCE) -> pd.Series:
    """``local_roots`` for a batch of blocks, small ones together up to ``at_once`` voxels."""
    sizes = blocks.map(len).to_numpy()
    group = np.cumsum(sizes) // at_once
    out = []
    for g in np.unique(group):
        some = np.flatnonzero(group == g)
        cell = np.repeat(np.arange(len(some)), sizes[some])
        roots = local_roots(np.concatenate([np.asarray(blocks.iloc[i]) for i in some]), cell, block, offsets)
        out += np.split(roots, np.cumsum(sizes[some])[:-1])
    return pd.Series(out, index=blocks.index)


def _pack(z: Column, y: Column, x: Column) -> Column:
    step = F.lit(1 << _BITS)
    return (z.cast("long") * step + y) * step + x


def _unpack(p: Column) -> list[Column]:
    mask = (1 << _BITS) - 1
    return [F.shiftright(p, 2 * _BITS).cast("int"), F.shiftright(p, _BITS).bitwiseAND(F.lit(mask)).cast("int"),
            p.bitwiseAND(F.lit(mask)).cast("int")]


@dataclass
class Components:
    """``voxels``: scan_id, keys, z, y, x, node. ``nodes``: scan_id, keys, node, comp, n
    and the node's half-open box. ``comp`` is the packed first voxel in z, y, x order."""
    voxels: DataFrame
    nodes: DataFrame
    keys: list[str]

    def sizes(self) -> DataFrame:
        """One row per component: voxels ``n`` and box a*/b*."""
        return self.nodes.groupBy(*self.keys, "comp").agg(
            F.sum("n").alias("n"), *[F.min(f"a{a}").alias(f"a{a}") for a in "zyx"],
            *[F.max(f"b{a}").alias(f"b{a}") for a in "zyx"])

    def join(self, facts: DataFrame, how: str = "inner") -> DataFrame:
        """Voxels with the columns of ``facts`` (keyed by component)."""
        extra = [c for c in facts.columns if c not in (*self.keys, "comp")]
        nodes = self.nodes.select(*self.keys, "node", "comp")
        on = [*self.keys, "comp"]
        small = fits_broadcast(self.nodes, 128)                 # a written table
        per_node = nodes.join(facts, on, how) if small else salted_join(nodes, facts, on, how, salt_by=("node",))
        per_node = per_node.select(*self.keys, "node", "comp", *extra)
        # a node has at most block^3 voxels, so this join has no hot key
        return self.voxels.join(F.broadcast(per_node) if small else per_node, [*self.keys, "node"]).drop("node")


def _blocks(mask: DataFrame, keys: list[str], block: int, connectivity: int) -> DataFrame:
    """One row per block and key: packed local positions and their local roots."""
    offsets = half_offsets(connectivity)

    def roots(pos: pd.Series) -> pd.Series:
        return roots_of_blocks(pos, block, offsets)

    find = F.pandas_udf(roots, T.ArrayType(T.IntegerType()))
    b = {f"_b{a}": F.floor(F.col(a) / block).cast("int") for a in "zyx"}
    local = ((F.col("z") % block) * block + F.col("y") % block) * block + F.col("x") % block
    rows = mask.select(*keys, *[c.alias(n) for n, c in b.items()], local.cast("int").alias("_p"))
    packed = rows.groupBy(*keys, *b).agg(F.collect_list("_p").alias("pos"))
    return packed.withColumn("root", find("pos"))


def _link(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node reachable from each node that has an edge."""
    both = edges.union(edges.select(*keys, F.col("b"), F.col("a")))            # edges is a written table
    label = both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    while True:
        seen = both.join(label.select(*keys, F.col("node").alias("b"), "comp"), [*keys, "b"])
        near = seen.groupBy(*keys, F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, [*keys, "node"]).select(
            *keys, "node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        step = cut_lineage(step)
        up = step.select(*keys, F.col("node").alias("comp"), F.col("comp").alias("up"))
        jumped = salted_join(step, up, [*keys, "comp"], "left", salt_by=("node",))
        label = cut_lineage(jumped.select(
            *keys, "node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        if label.filter(F.col("comp") != F.col("was")).isEmpty():
            return label.select(*keys, "node", "comp")
        label = label.drop("was")


def connected_components(mask: DataFrame, by: Sequence[str] = ("label",), connectivity: int = 6,
                         block: int = BLOCK) -> Components:
    """Components per scan and ``by`` columns; face-connected unless ``connectivity`` is 26."""
    keys = ["scan_id", *by]
    blocks = cut_lineage(_blocks(mask, keys, block, connectivity))
    cell = blocks.select(*keys, "_bz", "_by", "_bx", F.explode(F.arrays_zip("pos", "root")).alias("v"))

    def place(p: Column) -> list[Column]:
        return [(F.col("_bz") * block + F.floor(p / (block * block))).cast("int"),
                (F.col("_by") * block + F.floor(p / block) % block).cast("int"),
                (F.col("_bx") * block + p % block).cast("int")]
    z, y, x = place(F.col("v.pos"))
    voxels = cell.select(*keys, z.alias("z"), y.alias("y"), x.alias("x"), _pack(*place(F.col("v.root"))).alias("node"))

    rim = None
    for a in "zyx":
        side = (F.col(a) % block).isin(0, block - 1)
        rim = side if rim is None else rim | side
    faces = voxels.filter(rim)
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx"), d)])
                        for d in half_offsets(connectivity)])
    crossing = None
    for a in "zyx":
        c = F.floor((F.col(a) + F.col(f"o.d{a}")) / block) != F.floor(F.col(a) / block)
        crossing = c if crossing is None else crossing | c
    out = faces.withColumn("o", F.explode(offsets)).filter(crossing).select(
        *keys, *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "zyx"], F.col("node").alias("a"))
    edges = out.join(faces.withColumnRenamed("node", "b"), [*keys, "z", "y", "x"]).select(*keys, "a", "b").distinct()
    edges = cut_lineage(edges)

    nodes = voxels.groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"a{a}") for a in "zyx"],
        *[(F.max(a) + 1).alias(f"b{a}") for a in "zyx"])
    if edges.isEmpty():
        nodes = nodes.withColumn("comp", F.col("node"))
    else:
        nodes = nodes.join(_link(edges, keys), [*keys, "node"], "left").withColumn(
            "comp", F.coalesce("comp", "node"))
    return Components(voxels, cut_lineage(nodes), keys)


def runs_of_block(box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the x run each voxel of a block lies in; each run's label, first place and the first place of its component.

    Places count in z, y, x order through the block; faces connect. Background has runs too."""
    flat = box.ravel()
    new = np.empty(box.shape, bool)
    new[..., 0] = True
    new[..., 1:] = box[..., 1:] != box[..., :-1]
    run = np.cumsum(new.ravel()) - 1
    first = np.flatnonzero(new.ravel())
    run = run.reshape(box.shape)
    pairs = []
    for a, b in ((run[1:], run[:-1]), (run[:, 1:], run[:, :-1])):
        a, b = a.ravel(), b.ravel()
        if len(a):
            seen = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            pairs.append(np.stack([a[seen], b[seen]]))
    a, b = np.concatenate(pairs, 1) if pairs else np.empty((2, 0), np.int64)
    label = flat[first]
    same = (label[a] == label[b]) & (label[a] > 0)
    a, b = a[same], b[same]
    root = np.arange(len(first))
    while len(a):                                # smaller roots win; pairs settled are left out
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return run, label, first, first[root]


_PARTS = ("kind byte, scan_id long, label short, node long, n long, az int, ay int, ax int, bz int, by int, bx int, "
          "z0 int, y0 int, x0 int, axis byte, low boolean, meta binary, data binary")


def components_of_blocks(labels: DataFrame, block: int = BLOCK) -> Components:
    """Face-connected components per scan and label of a dense table of label blocks (edge ``block``; 0 is background).

    A block is read once; it gives a row per node and its faces towards other blocks as arrays of nodes."""
    keys = ["scan_id", "label"]
    kinds = {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _PARTS.split(", "))])

    def cells(b):
        for r in _rows(b, "label"):
            box = np.asarray(r["label"], np.int16).reshape(r["shape"])
            run, label, first, root = runs_of_block(box)
            z, rest = np.divmod(root, box.shape[1] * box.shape[2])
            y, x = np.divmod(rest, box.shape[2])
            node = ((z + r["z0"]) << 2 * _BITS) | ((y + r["y0"]) << _BITS) | (x + r["x0"])
            yield r, box, run, label, first, node

    def split(batches):
        for b in batches:
            for r, box, run, label, first, node in cells(b):
                length = np.diff(np.append(first, box.size))
                z, rest = np.divmod(first, box.shape[1] * box.shape[2])
                y, x = np.divmod(rest, box.shape[2])
                own = np.flatnonzero(label > 0)
                names, at = np.unique(node[own], return_inverse=True)
                k = len(names)
                n = np.bincount(at, length[own], k).astype(np.int64)
                lows, highs = [], []
                for v, e, o in ((z, z + 1, r["z0"]), (y, y + 1, r["y0"]), (x, x + length, r["x0"])):
                    low, high = np.full(k, 1 << 30), np.zeros(k, np.int64)
                    np.minimum.at(low, at, v[own])
                    np.maximum.at(high, at, e[own])
                    lows.append(low + o)
                    highs.append(high + o)
                kind = np.empty(k, np.int16)
                kind[at] = label[own]
                if k:
                    none = pa.nulls(k)
                    cols = [np.zeros(k), np.full(k, r["scan_id"]), kind, names, n, *lows, *highs]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, arrow)] + [none.cast(f.type) for f in arrow][len(cols):],
                                                     schema=arrow)
                name = np.where(label > 0, node, -1)
                faces = []
                for i, axis in enumerate("zyx"):
                    for low in (True, False):
                        if r[f"{axis}0"] == 0 if low else box.shape[i] < block:
                            continue
                        side = np.take(run, 0 if low else -1, i)
                        place = [r["z0"], r["y0"], r["x0"]]
                        place[i] += 0 if low else block         # the border, from both sides
                        faces.append([1, r["scan_id"], None, None, None, *[None] * 6, *place, i, low, None,
                                      np.stack([name[side], label[side].astype(np.int64)]).tobytes()])
                if faces:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*faces, strict=True), arrow, strict=True)], schema=arrow)

    def meet(batches):
        for key, rows in _runs(batches, ["scan_id", "axis", "z0", "y0", "x0"]):
            if len(rows) == 2:
                (a, of), (b, to) = (np.frombuffer(r["data"], np.int64).reshape(2, -1) for r in rows)
                hit = (of == to) & (of > 0)
                link = np.unique(np.stack([of[hit], a[hit], b[hit]], 1), axis=0)
                if len(link):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(link), key[0])), pa.array(link[:, 0].astype(np.int16)),
                                                      pa.array(link[:, 1]), pa.array(link[:, 2])], [*keys, "a", "b"])

    def name_voxels(batches):
        for b in batches:
            for r, box, run, label, _, node in cells(b):
                at = np.flatnonzero(box.ravel() > 0)
                z, rest = np.divmod(at, box.shape[1] * box.shape[2])
                y, x = np.divmod(rest, box.shape[2])
                cols = [(v + o).astype(np.int32) for v, o in ((z, r["z0"]), (y, r["y0"]), (x, r["x0"]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(at), r["scan_id"]), box.ravel()[at], *cols, node[run.ravel()[at]])],
                                                 [*keys, "z", "y", "x", "node"])

    dense = labels.select("scan_id", "z0", "y0", "x0", "shape", "label")
    parts = cut_lineage(dense.mapInArrow(split, _PARTS))
    faces = parts.filter("kind = 1").select("scan_id", "axis", "z0", "y0", "x0", "low", "meta", "data")
    edges = _dealt(faces, ["scan_id", "axis", "z0", "y0", "x0"], ["low"]).mapInArrow(meet, "scan_id long, label short, a long, b long")
    edges = cut_lineage(edges.distinct())
    nodes = parts.filter("kind = 0").select(*keys, "node", "n", *[f"a{a}" for a in "zyx"], *[f"b{a}" for a in "zyx"])
    if edges.isEmpty():
        nodes = nodes.withColumn("comp", F.col("node"))
    else:
        nodes = nodes.join(_link(edges, keys), [*keys, "node"], "left").withColumn("comp", F.coalesce("comp", "node"))
    voxels = dense.mapInArrow(name_voxels, "scan_id long, label short, z int, y int, x int, node long")
    return Components(voxels, cut_lineage(nodes), keys)


def ranked_sizes(parts: Components) -> DataFrame:
    """``sizes`` with ``rank`` 1..k per group: largest first, then first voxel."""
    sizes = parts.sizes().withColumn("minus", -F.col("n"))
    bucket = F.struct(F.col("minus").alias("size"), _unpack(F.col("comp"))[0].alias("plane"))
    return number_rows(sizes, parts.keys, bucket, ["minus", "comp"], "rank").drop("minus")


def relabel_by_size(parts: Components) -> DataFrame:
    """Voxels with ``component`` = 1..k by decreasing size."""
    rank = ranked_sizes(parts).select(*parts.keys, "comp", F.col("rank").alias("component"))
    return parts.join(rank).drop("comp")


def smallest_kept(min_cm3: Column, vox_cm3: Column) -> Column:
    """Voxels a component needs: at least one, the quotient truncated."""
    return F.greatest(F.lit(1), F.floor(min_cm3 / vox_cm3).cast("int"))


def kept_components(parts: Components, scans: DataFrame, min_cm3: Column | float | None = None) -> DataFrame:
    """Component rows at or above the minimum volume (per class by default; <= 0 keeps all)."""
    limit = min_volume(F.col("label")) if min_cm3 is None else min_cm3
    limit = F.lit(float(limit)) if not isinstance(limit, Column) else limit
    sizes = parts.sizes()
    facts = scans.select("scan_id", voxel_cm3().alias("_cm3"))
    both = attach(sizes, facts, sized_by=scans, salt_by=("comp",))
    return both.filter((limit <= 0) | (F.col("n") >= smallest_kept(limit, F.col("_cm3"))))


def drop_small(parts: Components, scans: DataFrame, min_cm3: Column | float | None = None) -> DataFrame:
    """Voxels of the components that are large enough; every such one stays, not just the largest."""
    kept = kept_components(parts, scans, min_cm3).select(*parts.keys, "comp")
    return parts.join(kept).drop("comp")


def count_components(parts: Components, scans: DataFrame, min_cm3: Column | float | None = None) -> DataFrame:
    """Per group: components, those kept by ``drop_small`` and the specks dropped."""
    raw = parts.sizes().groupBy(*parts.keys).agg(F.count(F.lit(1)).alias("raw"))
    kept = kept_components(parts, scans, min_cm3).groupBy(*parts.keys).agg(
        F.count(F.lit(1)).alias("components"), F.sum("n").alias("voxels"))
    both = raw.join(kept, parts.keys, "left").na.fill(0, ["components", "voxels"])
    return both.withColumn("specks", F.col("raw") - F.col("components"))


def largest_component(parts: Components, x_range: tuple[Column, Column] | None = None) -> DataFrame:
    """Voxels of the largest component per group, optionally only x in [lo, hi)."""
    best = F.max(F.struct("n", -F.col("comp")))
    top = parts.sizes().groupBy(*parts.keys).agg(best.alias("b"))
    top = top.select(*parts.keys, (-F.col("b.col2")).alias("comp"))
    out = parts.join(top).drop("comp")
    if x_range is not None:
        out = out.filter((F.col("x") >= x_range[0]) & (F.col("x") < x_range[1]))
    return out

"""Operator 4: near-duplicate documents with a MinHash LSH forest.

A document is its set of distinct five-word shingles. Equal sets become one class.
A forest of ``TREES`` orders sorts the classes by labels of ``DEPTH`` minima each;
classes that share a prefix lie beside each other. A region is a prefix of
``SHALLOW`` minima, whatever its size; the work on a region of more than ``REGION``
classes is dealt out in blocks. Candidates of a region are

1. the class most like all others (the medoid of the signatures) with each other one,
2. then, between classes not yet connected, the neighbours with the longest common
   prefixes in its order,
3. then every other pair not yet connected,

where a large region takes the first two steps block by block and the last one block
against block, leaving out the pairs inside the component that holds most of it; each
only where the signatures make the similarity possible (five standard errors below it).
Links are confirmed on full sets; in the last step the sets of members with an open pair
go to their region, which gives out links between components, not pairs. A pair at similarity s shares a prefix
of three in one of 16 trees but for (1 - s^3)^16: 3e-7 at 0.85, 2e-5 at 0.8.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text
from voxelspark.llm.links import components
from voxelspark.llm.text import U64

SHINGLE = 5
PERCENT = 80                    # similarity that links, in percent
TREES, DEPTH, SHALLOW = 16, 8, 3                # trees: a power of two
REGION = 2048                   # about so many classes of a region to a task
HASHES = TREES * DEPTH
LOW = np.frombuffer(text.LOWER, np.uint8)
MEMBERS = exchange.Records(ragged="signature", region="i8", doc="i8", component="i8", side="u1")
PAIRS = "a long, b long"


def shingles(buf: np.ndarray, bounds: np.ndarray, size: int = SHINGLE):
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    n = len(bounds) - 1
    start, end, of = text.words(buf, bounds)
    words = text.Hashes(text.Hashes(LOW[buf])(start, end))
    at = np.searchsorted(start, bounds)
    count = np.diff(at)
    some = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    doc = np.repeat(np.arange(n), some)
    lo = at[doc] + text.spread(some)
    h = words(lo, np.minimum(lo + size, at[doc + 1]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _factors() -> np.ndarray:
    return text.mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of 16 bits for each text that has shingles."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), HASHES), np.uint16)
    for k, factor in enumerate(_factors()):
        low = np.minimum.reduceat(h * factor, starts) if len(starts) else np.zeros(0, U64)
        out[:, k] = (text.mix(low) >> U64(48)).astype(np.uint16)
    return out


def digests(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2, signature``: two hashes name the set."""
    def run(batches):
        for block in text.blocks(batches):
            h, at = shingles(*text.utf8(block.column("text")), size)
            some = np.diff(at) > 0
            keys = []
            for salt in (0, 0x5851F42D4C957F2D):
                total = np.zeros(len(at) - 1, U64)
                if some.any():
                    total[some] = np.add.reduceat(text.mix(h ^ U64(salt)), at[:-1][some])
                keys.append(pa.array(total.view(np.int64)))
            sig = np.full(len(some), None, object)
            sig[some] = [r.tobytes() for r in signatures(h, at)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(at), pa.int64()), *keys, pa.array(sig, pa.binary())],
                                             ["doc_id", "n_shingles", "k1", "k2", "signature"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, signature binary")


def _named(name, tree):
    """A region's name tells its tree in the last bits."""
    return name.bitwiseAND(F.lit(-TREES).cast("long")).bitwiseOR(tree.cast("long"))


def regions(classes: DataFrame) -> DataFrame:
    """``region, doc, n``: classes that share a prefix, by tree, and how many they are."""
    width = 2 * DEPTH
    rows = classes.select("doc", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "doc", _named(F.xxhash64("tree", F.expr(f"substring(signature, tree * {width} + 1, {2 * SHALLOW})")), F.col("tree")).alias("region"))
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return exchange.cut_lineage(rows.join(sizes, "region"))


def blocks(table: DataFrame) -> DataFrame:
    """Each large region as blocks of its own, dealt anew in every region."""
    part = F.pmod(F.xxhash64("doc", "region"), F.ceil(F.col("n") / REGION))
    own = F.when(F.col("n") > REGION, _named(F.xxhash64("region", part), F.pmod("region", F.lit(TREES)))).otherwise(F.col("region"))
    return table.select(own.alias("region"), "doc", "component", F.lit(0).alias("side"))


def block_pairs(table: DataFrame) -> DataFrame:
    """Small regions, and of large ones every two blocks that can hold a pair not yet connected.

    The component that holds most of a region meets only the others, which also meet each other.
    Members of two different blocks are on sides 1 and 2; pairs of one side meet elsewhere."""
    small = table.filter(F.col("n") <= REGION).select("region", "doc", "component", F.lit(0).alias("side"))
    large = table.filter(F.col("n") > REGION)
    parts = large.groupBy("region", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(
        F.max_by("component", "c").alias("main"), F.max("c").alias("most"), F.sum("c").alias("all")).filter("most < all")
    parts = parts.select("region", "main", F.ceil(F.col("most") / REGION).alias("mains"), F.ceil((F.col("all") - F.col("most")) / REGION).alias("others"))
    own = F.col("component") == F.col("main")
    block = F.pmod(F.xxhash64("doc", "region"), F.when(own, F.col("mains")).otherwise(F.col("others")))
    rows = large.join(parts, "region").withColumn("own", own).withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, if(own, others, others + mains) - 1)")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    key = (F.when(F.col("own"), F.xxhash64("region", F.lit(1), "other", "block"))
           .when(F.col("other") >= F.col("others"), F.xxhash64("region", F.lit(1), "block", F.col("other") - F.col("others")))
           .otherwise(F.xxhash64("region", F.lit(0), low, high)))
    key = _named(key, F.pmod("region", F.lit(TREES)))
    side = (F.when(F.col("own"), 2).when(F.col("other") >= F.col("others"), 1)
            .when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2))
    return small.unionByName(rows.select(key.alias("region"), "doc", "component", side.alias("side")))


def _groups(m: dict):
    """Members by region: (region, docs, components, sides, signatures)."""
    raw, _ = m["signature"]
    sig = np.frombuffer(raw.tobytes(), np.uint16).reshape(-1, HASHES)
    order = np.lexsort((m["doc"], m["region"]))
    cut = np.flatnonzero(np.r_[True, m["region"][order][1:] != m["region"][order][:-1], True]) if len(order) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        part = order[a:b]
        yield m["region"][part[0]], m["doc"][part], m["component"][part], m["side"][part], sig[part]


def _alike(sig: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (sig == row).sum(1)


def neighbours(tree: int, component: np.ndarray, sig: np.ndarray, least: float):
    """Each member with the two of other components, later in the order of its tree, whose labels share most with its own.

    In that order the common prefix only gets shorter with distance."""
    order = np.lexsort(sig[:, tree * DEPTH:(tree + 1) * DEPTH].T[::-1])
    for k, i in enumerate(order):
        other = order[k + 1:][component[order[k + 1:]] != component[i]]
        yield i, other[_alike(sig[other], sig[i]) >= least][:2]


def partners(tree: int, i: int, component: np.ndarray, side: np.ndarray, sig: np.ndarray, least: float) -> np.ndarray:
    """Later members of a region that may be linked with member ``i``, are not connected with it yet and did not meet
    it in an earlier tree."""
    apart = component[i + 1:] != component[i]
    if side[i]:
        apart &= side[i + 1:] != side[i]
    other = np.flatnonzero(apart) + i + 1
    same = sig[other] == sig[i]
    near = same.sum(1) >= least
    met = same[near].reshape(-1, TREES, DEPTH)[:, :tree, :SHALLOW].all(2).any(1)
    return other[near][~met]


def join_region(tree: int, doc: np.ndarray, component: np.ndarray, side: np.ndarray, sig: np.ndarray, sets: list[np.ndarray],
                percent: int, least: float) -> list[tuple[int, int]]:
    """Links that connect the components of a region: every open pair is compared, but one link between two components is enough."""
    component = component.copy()
    size = np.array([len(s) for s in sets])
    at = np.cumsum(size) - size
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(shingle), bool)
    out = []
    for i in range(len(doc) - 1):
        other = partners(tree, i, component, side, sig, least)
        if not len(other):
            continue
        mine = shingle[at[i]:at[i] + size[i]]
        own[mine] = True
        theirs = own[shingle[np.repeat(at[other], size[other]) + text.spread(size[other])]]
        own[mine] = False
        common = np.add.reduceat(theirs, np.cumsum(size[other]) - size[other], dtype=np.int64)
        other = other[100 * common >= percent * (size[i] + size[other] - common)]
        names, first = np.unique(component[other], return_index=True)
        out += [(int(doc[i]), int(doc[j])) for j in other[first]]
        component[np.isin(component, names)] = component[i]
    return out


def _floor(percent: int) -> float:
    """Least number of equal minima at which the similarity is still possible."""
    t = percent / 100
    return HASHES * t - 5 * math.sqrt(HASHES * t * (1 - t))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest id reachable over links), ``kept``.

    Texts without words, null ones too, have no shingles and link with nothing. A null id is an id
    smaller than all others. Rows that share an id are one document, linked with whatever any of them
    is linked with; each gets a row. An empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    n = exchange.slots(spark)
    docs = exchange.documents(docs, id_col, text_col)
    rows = exchange.cut_lineage(digests(docs, size))
    classes = exchange.cut_lineage(rows.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(
        F.min("doc_id").alias("doc"), F.first("signature").alias("signature")))
    least = _floor(percent)

    def members(table: DataFrame) -> DataFrame:
        """Region members with their signatures, many regions to a slot."""
        def run(batches):
            for b in batches:
                region = b.column("region").to_numpy()
                sig = b.column("signature").to_pylist()
                yield MEMBERS.pack(region % n, {
                    "region": region, "doc": b.column("doc").to_numpy(), "component": b.column("component").to_numpy(),
                    "side": b.column("side").to_numpy(), "signature": (np.frombuffer(b"".join(sig), np.uint8), np.full(len(sig), 2 * HASHES, np.int64))})
        held = table.join(classes.select("doc", "signature"), "doc").select("region", "doc", "component", "side", "signature")
        return held.mapInArrow(run, exchange.PACKED).groupBy("slot")

    def screen(table):
        """Members that are possibly linked with another one of their region."""
        out = []
        for region, doc, _, _, sig in _groups(MEMBERS.unpack(table)):
            some = np.zeros(len(doc), bool)
            for i in range(len(doc) - 1):
                if not some[i] or not some[i + 1:].all():
                    near = np.flatnonzero(_alike(sig[i + 1:], sig[i]) >= least) + i + 1
                    some[near] = True
                    some[i] |= len(near) > 0
            out.append((np.full(some.sum(), region), doc[some]))
        return pa.table({"region": np.concatenate([np.zeros(0, np.int64), *(r for r, _ in out)]),
                         "doc": np.concatenate([np.zeros(0, np.int64), *(d for _, d in out)])})

    def candidates(step: str):
        def run(table):
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for region, doc, component, side, sig in _groups(MEMBERS.unpack(table)):
                if step == "medoid":
                    mode = np.array([np.bincount(np.unique(c, return_inverse=True)[1]).argmax() for c in sig.T])
                    mode = np.array([np.unique(c)[m] for c, m in zip(sig.T, mode, strict=True)], np.uint16)
                    hub = int(_alike(sig, mode).argmax())
                    near = np.flatnonzero(_alike(sig, sig[hub]) >= least)
                    a.append(np.full(len(near), doc[hub]))
                    b.append(doc[near])
                    continue
                if (component == component[0]).all():
                    continue
                for i, near in neighbours(int(region) % TREES, component, sig, least):
                    a.append(np.full(len(near), doc[i]))
                    b.append(doc[near])
            a, b = np.concatenate(a), np.concatenate(b)
            keep = a != b
            return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}) if step != "medoid" else pa.table({"a": a[keep], "b": b[keep]})
        return run

    def still_open(table):
        """Members with a partner that they are not connected with."""
        out = {k: [] for k in ("region", "doc", "component", "side", "signature")}
        for region, doc, component, side, sig in _groups(MEMBERS.unpack(table)):
            if (component == component[0]).all():
                continue
            some = np.zeros(len(doc), bool)
            for i in range(len(doc) - 1):
                other = partners(int(region) % TREES, i, component, side, sig, least)
                some[other] = True
                some[i] |= len(other) > 0
            for k, v in zip(out, (np.full(some.sum(), region), doc[some], component[some], side[some], [r.tobytes() for r in sig[some]]), strict=True):
                out[k].extend(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    def join(key, table):
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
        doc, component, side = (table.column(c).to_numpy() for c in ("doc", "component", "side"))
        order = np.argsort(doc)
        data = table.column("data").to_pylist()
        found = join_region(key[0].as_py() % TREES, doc[order], component[order], side[order], sig[order], [_set(data[k]) for k in order],
                            percent, least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    all_ = regions(classes)
    few = all_.filter(F.col("n") <= REGION).select("region", "doc", F.lit(0).cast("long").alias("component"), F.lit(0).alias("side"))
    near = exchange.cut_lineage(members(few).applyInArrow(screen, "region long, doc long").withColumn("n", F.lit(0).cast("long"))
                                .unionByName(all_.filter(F.col("n") > REGION)))
    wanted = exchange.cut_lineage(near.select("doc").distinct())
    sets = exchange.cut_lineage(_sets(docs, F.broadcast(wanted) if wanted.count() <= exchange.FEW else wanted, size))
    found, links, tested = None, None, None

    def connected(table: DataFrame) -> DataFrame:
        if found is None:
            return table.withColumn("component", F.col("doc"))
        return table.join(found, table["doc"] == found["node"], "left").select("region", "doc", "n", F.coalesce("component", "doc").alias("component"))

    def linked(new: DataFrame) -> tuple[DataFrame, DataFrame]:
        every = new if links is None else links.unionByName(new)
        return every, exchange.cut_lineage(components(every.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    for step in ("medoid", "neighbours"):
        pairs = members(blocks(connected(near))).applyInArrow(candidates(step), PAIRS).distinct()
        if tested is not None:
            same = ((F.least(tested["a"], tested["b"]) == F.least(pairs["a"], pairs["b"]))
                    & (F.greatest(tested["a"], tested["b"]) == F.greatest(pairs["a"], pairs["b"])))
            pairs = pairs.join(tested, same, "left_anti")
        pairs = exchange.cut_lineage(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        links, found = linked(exchange.cut_lineage(_confirm(pairs, sets, percent, n)))
    opened = exchange.cut_lineage(members(block_pairs(connected(near))).applyInArrow(
        still_open, "region long, doc long, component long, side int, signature binary"))
    if not opened.isEmpty():
        new = exchange.cut_lineage(opened.join(sets, "doc").groupBy("region").applyInArrow(join, PAIRS))
        links, found = linked(new)
    named = classes.select("k1", "k2", "n_shingles", "doc")
    if found is not None:
        named = named.join(found, named["doc"] == found["node"], "left").select(
            "k1", "k2", "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    else:
        named = named.withColumnRenamed("doc", "component_id")
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select(exchange.restore_id(), "n_shingles", F.when(own != exchange.NO_ID, own).alias("component_id"),
                      (own == F.col("doc_id")).alias("kept"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``doc, data``: full shingle sets of the wanted documents, 40 bits a shingle."""
    def run(batches):
        for block in text.blocks(batches):
            h, at = shingles(*text.utf8(block.column("text")), size)
            low, high = h.astype(np.uint32), (h >> U64(32)).astype(np.uint8)
            data = [low[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(data, pa.binary())], ["doc", "data"])
    return docs.join(wanted.withColumnRenamed("doc", "doc_id"), "doc_id").mapInArrow(run, "doc long, data binary").filter("length(data) > 0")


def _set(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.unique(np.frombuffer(data, np.uint32, n).astype(U64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(U64) << U64(32))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs whose full sets are similar. A document with very many partners is spread over slots."""
    slot = F.pmod(F.xxhash64("a", F.pmod("b", F.lit(64))), F.lit(n)).cast("int")
    pairs = pairs.withColumn("slot", slot)
    many = pairs.join(sets.withColumnRenamed("doc", "b"), "b").select("slot", "a", "b", "data")
    one = pairs.select("slot", "a").distinct().join(sets.withColumnRenamed("doc", "a"), "a").select(
        F.col("slot").alias("slot_a"), F.col("a").alias("own"), F.col("data").alias("own_data"))

    def check(left, right):
        own: dict = {}
        for a, data in zip(right.column("own").to_pylist(), right.column("own_data").to_pylist(), strict=True):
            own.setdefault(a, []).append(_set(data))
        out = []
        for a, b, data in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), left.column("data").to_pylist(), strict=True):
            theirs = _set(data)
            for mine in own.get(a, ()):
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                common = int((mine[at] == theirs).sum())
                if 100 * common >= percent * (len(mine) + len(theirs) - common):
                    out.append((a, b))
                    break
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return many.groupBy("slot").cogroup(one.groupBy("slot_a")).applyInArrow(check, PAIRS).distinct()


def op4_forest_groups(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)

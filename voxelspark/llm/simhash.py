"""Operator 11: near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments, each the key of one table. Two fingerprints within
``radius`` bits agree in some segment up to a few bits, so each looks up the small
Hamming ball around its own key in every table and compares whole fingerprints with what it
meets. How many segments: whatever costs least for the number of distinct fingerprints;
every choice finds every link.

Fingerprints, not documents, are linked: equal ones are one node, so a group of copies is
one row. A table key that many fingerprints share is dealt as blocks of probes against
blocks of entries, counted first. A task gives out one link per fingerprint it connects,
never the pairs of a dense group.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text
from voxelspark.llm.links import components
from voxelspark.llm.text import U64

WORDS, RADIUS, SEED = 4, 4, 42
BITS = 64
BLOCK = 4096                    # probes or entries of one key that meet in one group
AT_ONCE = 1 << 22               # pairs compared at once
SLOT_ROWS = 1 << 19             # probes and entries of a task
_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(data: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of a lower-cased text, repeats included; fewer words are one shingle."""
    own = data.split()
    if not own:
        return np.zeros(0, U64)
    joined = memoryview(b" ".join(own))
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.r_[0, ends[:-1]]
    k = min(words, len(own))
    of = xxhash.xxh64_intdigest
    spans = zip(starts[:len(own) - k + 1].tolist(), (ends[k - 1:] - 1).tolist(), strict=True)
    return np.fromiter((of(joined[a:b], SEED) for a, b in spans), U64, len(own) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, counted in pieces so that a long text needs no long bit table."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp``: one row a document, the fingerprint as a signed long."""
    def make(batches):
        for block in text.blocks(batches):
            buf, bounds = text.utf8(block.column("text"))
            whole = buf.tobytes().lower()                # bytes: A-Z only
            fps = np.array([fingerprint(shingle_hashes(whole[a:b], words)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], U64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(fps.view(np.int64))], schema=_FINGERPRINTS)
    return exchange.documents(docs).mapInArrow(make, "doc_id long, fp long")


def plan(n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """Segments (lowest bit, bits, ball radius) for ``n`` fingerprints: the cheapest of all numbers of segments.

    With m segments and radius = m q + a, fingerprints within the radius are within q bits in one of the first
    a + 1 segments or within q - 1 in one of the others, or the sum would be larger. A probe that is dealt costs
    about as much as 16 comparisons, and meets n / 2^bits entries if keys are spread evenly. More segments than
    ``radius`` would need no balls, but their short keys fill up as the tables grow."""
    best = None
    for m in range(1, max(1, radius) + 1):
        q, a = divmod(radius, m)
        edge = [round(BITS * k / m) for k in range(m + 1)]
        segments = [(lo, hi - lo, q if k <= a else q - 1) for k, (lo, hi) in enumerate(zip(edge, edge[1:], strict=False))]
        if q > 2:
            continue
        segments = [s for s in segments if s[2] >= 0]
        cost = sum(len(ball(b, r)) * (16 + n / 2 ** b) for _, b, r in segments)
        if best is None or cost < best[0]:
            best = cost, segments
    if best is None:
        raise ValueError(f"no segments for a radius of {radius}")
    return best[1]


def ball(bits: int, radius: int) -> list[int]:
    """All keys within ``radius`` (at most 2) bits of zero."""
    out = [0]
    if radius >= 1:
        out += [1 << i for i in range(bits)]
    if radius >= 2:
        out += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return out


def _rows(fps: DataFrame, segments: list[tuple[int, int, int]]) -> DataFrame:
    """``segment, key, fp, probe``: an entry in each table and a probe for each key of the ball."""
    tables = []
    for s, (low, bits, radius) in enumerate(segments):
        mask = (1 << bits) - 1
        key = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask).cast("long")) if bits < BITS else F.col("fp")
        tables.append(F.struct(F.lit(s).alias("segment"), key.alias("key"), F.lit(False).alias("probe"), F.lit(bits).alias("bits"), F.lit(radius).alias("radius")))
    rows = fps.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.*")
    one = F.lit(1).cast("long")
    places = F.sequence(F.lit(0), F.col("bits") - 1)
    singles = F.transform(places, lambda i: F.call_function("shiftleft", one, i))
    doubles = F.flatten(F.transform(places, lambda i: F.transform(
        F.slice(places, F.lit(1), i), lambda j: F.call_function("shiftleft", one, i).bitwiseOR(F.call_function("shiftleft", one, j)))))
    none = F.array().cast("array<long>")
    flips = F.concat(F.array(F.lit(0).cast("long")), F.when(F.col("radius") >= 1, singles).otherwise(none), F.when(F.col("radius") >= 2, doubles).otherwise(none))
    probes = rows.select("fp", "segment", "key", F.explode(flips).alias("flip")).select(
        "segment", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "fp", F.lit(True).alias("probe"))
    return rows.select("segment", "key", "fp", "probe").unionByName(probes)


def connect(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray) -> None:
    """Merge the components of nodes ``u[i]`` and ``v[i]`` (in place: each label is a node of its component, roots their own)."""
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        u, v = u[differ], v[differ]
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:                                      # shortcut
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked(group: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links within the groups connect: one per fingerprint at most."""
    nodes, node = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    order = np.lexsort((probe, group))
    g, node, probe = group[order], node[order], probe[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(g)).astype(np.int64)
    entries = np.add.reduceat(~probe, first) if len(first) else first
    split = first + entries                              # entries come first, then the probes
    many = np.repeat(entries, last - split)              # comparisons of each probe
    who = np.concatenate([np.arange(a, b) for a, b in zip(split.tolist(), last.tolist(), strict=True)]) if len(first) else first
    whom = np.repeat(first, last - split)
    ends = np.cumsum(many)
    at = 0
    while at < len(who):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        a = np.repeat(node[who[at:to]], many[at:to])
        b = node[np.repeat(whom[at:to], many[at:to]) + text.spread(many[at:to])]
        hit = np.bitwise_count(nodes[a] ^ nodes[b]) <= radius
        connect(len(nodes), a[hit], b[hit], label)
        at = to
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``u, v``: links that connect the distinct fingerprints ``fp`` as all their links within the radius do."""
    segments = plan(n := fps.count(), radius)
    probes = sum(len(ball(b, r)) for _, b, r in segments)
    slots = max(exchange.slots(fps.sparkSession), -(-n * (probes + len(segments)) // SLOT_ROWS))
    rows = _rows(fps, segments)
    counts = rows.groupBy("segment", "key").agg(F.count_if(~F.col("probe")).alias("entries"), F.count_if("probe").alias("probes"))
    hot = exchange.cut_lineage(counts.filter((F.col("entries") > block) | ((F.col("probes") > block) & (F.col("entries") > 1))).select(
        "segment", "key", F.ceil(F.col("entries") / block).cast("int").alias("rows"), F.ceil(F.col("probes") / block).cast("int").alias("cols")))
    few = hot.count()
    if not few:
        dealt = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        # an entry goes to its block of entries, once for each block of probes; a probe the other way round
        rows = rows.join(F.broadcast(hot) if few <= 100_000 else hot, ["segment", "key"], "left")
        deal = F.xxhash64(F.col("fp"), F.lit("block"))
        own = F.when(F.col("probe"), F.pmod(deal, F.coalesce("cols", F.lit(1)))).otherwise(F.pmod(deal, F.coalesce("rows", F.lit(1)))).cast("int")
        others = F.coalesce(F.when(F.col("probe"), F.col("rows")).otherwise(F.col("cols")), F.lit(1))
        dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        dealt = dealt.withColumns({"i": F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")),
                                   "j": F.when(F.col("probe"), F.col("own")).otherwise(F.col("other"))})
    group = F.xxhash64("segment", "key", "i", "j")
    dealt = dealt.select(group.alias("group"), "fp", "probe", F.pmod(group, F.lit(slots)).cast("int").alias("slot"))

    def meet(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_numpy(zero_copy_only=False) for c in ("group", "fp", "probe")]
        u, v = linked(cols[0], cols[1].view(U64), cols[2], radius)
        return pa.table([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=_LINKS)

    return dealt.groupBy("slot").applyInArrow(meet, "u long, v long")


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``: fingerprints that differ in at most ``radius`` bits are linked.

    ``component_id`` is the smallest id reachable. A null text has no words; texts without
    words have fingerprint zero and are linked like any others. Shorter texts than a shingle
    are one shingle; a very long text is hashed whole, its bits counted in pieces. A null id
    is smaller than all others and stays null. Each row counts as a document of its own, also
    if it repeats another or shares its id. Two groups of hashes that fall on one number
    only add comparisons: every link is checked on whole fingerprints. Other columns are
    ignored; an empty table gives no rows."""
    rows = exchange.cut_lineage(fingerprints(docs, words))
    nodes = exchange.cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = components(links(nodes.select("fp"), radius))
    root = F.coalesce("component", "fp")
    nodes = nodes.join(grouped, nodes["fp"] == grouped["node"], "left").select("fp", "least", root.alias("root"))
    nodes = exchange.cut_lineage(nodes)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    names = nodes.join(least, "root").select("fp", "component_id")
    return rows.join(names, "fp").select(exchange.restore_id(), "fp", exchange.restore_id("component_id"))


def op11_simhash_groups(spark, sf_dir):
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Operator 12: exact centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors become integers and are put in the order of a Hilbert curve through the space that
the starting centroids span, as distances to centroids differ in such directions only. Runs
of the order are blocks; a block's zone map holds the smallest and largest value of every
component and of every curve direction, and the sum of its vectors. In each round the boxes
bound how much farther one centroid is than another for all vectors of a block: a centroid
that is farther than another one throughout is no candidate. A block with one candidate is
counted by its sums alone; the vectors of the others are compared with their candidates,
exactly.

Blocks are written once and read every round. A task returns sums per cluster, so nothing
but centroids passes the driver.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange

SCALE, DIMS, K, ROUNDS, SEED = 1024, 64, 8, 10, 3
LIMIT = 1 << 27                 # largest magnitude of an integer component
FLOAT_SAFE = 1 << 22            # up to here products of vectors are exact as doubles
BLOCK = 64                      # vectors of a block
_KEYED = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("x", pa.binary())])
_BLOCKS = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("low", pa.binary()), ("high", pa.binary()),
                     ("total", pa.binary()), ("squares", pa.int64())])
BLOCKS = "n int, ids binary, x binary, low binary, high binary, total binary, squares long"
_LOW = (1 << 31) - 1


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: vectors of ``dims`` components, none null or non-finite, as integers ``floor(scale * x)``."""
    v = F.col(vec_col).cast("array<double>")
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / scale))
    kept = df.filter(v.isNotNull() & good)
    return kept.select(F.coalesce(F.col(id_col).cast("long"), F.lit(exchange.NO_ID)).alias("vec_id"),
                       F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("x"))


def starting_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes; rows that share an id by their components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(exchange.restore_id("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below ``2**bits`` (columns times bits at most 63)."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for level in range(bits - 1, 0, -1):                 # undo rotations, from the coarsest level
        low = (1 << level) - 1
        for i in range(n):
            on = (x[i] >> level & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(on, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):                                # Gray code
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ flip) >> level & 1)
    return key


class Curve:
    """Orthonormal directions that span the starting centroids, and places on the curve through them."""

    def __init__(self, centroids: np.ndarray):
        span = (centroids[1:] - centroids[:1]).astype(float)
        self.basis = np.linalg.qr(span.T)[0]             # components x directions
        at = centroids @ self.basis
        self.middle, self.width = at.mean(0), np.maximum(at.std(0), 1.0)
        self.bits = min(16, 62 // max(1, self.basis.shape[1]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.basis.shape[1]:
            return np.zeros(len(x), np.int64)
        z = np.clip((x @ self.basis - self.middle) / self.width, -20, 20)
        return hilbert(np.minimum((1 << self.bits) / (1 + np.exp(-2 * z)), (1 << self.bits) - 1), self.bits)


def _floats(binary: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), dtype).reshape(-1, width)


def blocks(vectors: DataFrame, curve: Curve, size: int = BLOCK) -> DataFrame:
    """The vectors in curve order, a row for each ``size`` of them, with their zone maps."""
    def place(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            raw = x.astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array(curve(x)), b.column("vec_id"), pa.array([r.tobytes() for r in raw], pa.binary())], schema=_KEYED)

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _floats(b.column("x"), "<i4", len(b.column("x")[0].as_py()) // 4).astype(np.int64)
            ids = b.column("vec_id").to_numpy()
            along = np.hstack([x, x @ curve.basis])
            first = np.arange(0, len(x), size)
            low, high = np.minimum.reduceat(along, first), np.maximum.reduceat(along, first)
            total, squares = np.add.reduceat(x, first), np.add.reduceat((x * x).sum(1), first)
            ends = np.append(first[1:], len(x)).tolist()
            spans = list(zip(first.tolist(), ends, strict=True))
            x = x.astype("<i4")
            yield pa.RecordBatch.from_arrays([
                pa.array([e - a for a, e in spans], pa.int32()), pa.array([ids[a:e].tobytes() for a, e in spans], pa.binary()),
                pa.array([x[a:e].tobytes() for a, e in spans], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary()),
                pa.array([r.tobytes() for r in high], pa.binary()), pa.array([r.tobytes() for r in total], pa.binary()),
                pa.array(squares)], schema=_BLOCKS)

    keyed = vectors.mapInArrow(place, "key long, vec_id long, x binary")
    ordered = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id", "x")
    return exchange.cut_lineage(ordered.mapInArrow(pack, BLOCKS))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest for a vector in each box.

    For vectors x, |x - a|^2 - |x - b|^2 = |a|^2 - |b|^2 - 2 x (a - b): linear, so smallest at a corner. The part
    of a - b along the curve's directions is bounded by their ranges, the rest by those of the components. Centroid
    a is out if the smallest is above zero by more than rounding can reach."""
    k, n = centroids.shape
    c = centroids.astype(float)
    a, b = (i.ravel() for i in np.indices((k, k)))
    differ = c[a] - c[b]
    along = differ @ basis
    form = np.hstack([differ - along @ basis.T, along])
    norms = (c * c).sum(1)
    largest = high @ np.maximum(form, 0).T + low @ np.minimum(form, 0).T
    reach = (np.abs(high) + np.abs(low)) @ np.abs(form).T + norms[a] + norms[b]
    farther = norms[a] - norms[b] - 2 * largest > 1e-9 * reach
    return ~farther.reshape(-1, k, k).any(2)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller on ties) and the squared distance, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= FLOAT_SAFE:
        c = centroids.astype(float)
        score = (c * c).sum(1) - 2 * (x.astype(float) @ c.T)
    else:
        score = (centroids * centroids).sum(1) - 2 * (x @ centroids.T)
    best = score.argmin(1)
    return best, ((x - centroids[best]) ** 2).sum(1)


def compare(batch: pa.RecordBatch, centroids: np.ndarray, basis: np.ndarray, settle: bool):
    """Cluster of every vector, by groups of blocks with the same candidates: block numbers, vectors, clusters, distances.

    With ``settle``, blocks with one candidate come without their vectors."""
    width = centroids.shape[1] + basis.shape[1]
    may = candidates(_floats(batch.column("low"), float, width), _floats(batch.column("high"), float, width), centroids, basis)
    sets, which = np.unique(may, axis=0, return_inverse=True)
    for s, mask in enumerate(sets):
        of = np.flatnonzero(which.ravel() == s)
        numbers = np.flatnonzero(mask)
        if settle and len(numbers) == 1:
            yield of, None, numbers, None
            continue
        x = _floats(batch.column("x").take(pa.array(of)), "<i4", centroids.shape[1]).astype(np.int64)
        best, distance = nearest(x, centroids[numbers])
        yield of, x, numbers[best], distance


def assign_sums(table: DataFrame, centroids: np.ndarray, basis: np.ndarray) -> tuple[list[list[int]], list[int], list[int]]:
    """Of each cluster: componentwise sums, number of vectors, and summed distance, as Python integers."""
    k, n = centroids.shape

    def work(batches):
        sums = np.zeros((k, n + 3), np.int64)            # components, vectors, distance in two parts
        far = [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            counts = b.column("n").to_numpy()
            for of, x, cluster, distance in compare(b, centroids, basis, True):
                if x is None:
                    c, picked = int(cluster[0]), pa.array(of)
                    total, many = _floats(b.column("total").take(picked), np.int64, n).sum(0), int(counts[of].sum())
                    sums[c, :n] += total
                    sums[c, n] += many
                    own = [int(v) for v in centroids[c]]
                    far[c] += sum(b.column("squares").take(picked).to_pylist()) + many * sum(v * v for v in own) - 2 * sum(
                        v * int(t) for v, t in zip(own, total, strict=True))
                    continue
                for c in np.unique(cluster):
                    mine = cluster == c
                    sums[c, :n] += x[mine].sum(0)
                    sums[c, n] += mine.sum()
                    far[c] += (int((distance[mine] >> 31).sum()) << 31) + int((distance[mine] & _LOW).sum())
        for c in range(k):
            sums[c, n + 1:] = far[c] & _LOW, far[c] >> 31
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = table.mapInArrow(work, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "s"))
    out = [[0] * (n + 3) for _ in range(k)]
    for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["cluster"]][r["i"]] = int(r["s"])
    return [o[:n] for o in out], [o[n] for o in out], [o[n + 1] + (o[n + 2] << 31) for o in out]


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding",
            dims: int = DIMS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid``: ``rounds`` of exact k-means on integers.

    Vectors with another number of components, a null or a non-finite one are left out, and so are those with a
    component of 2^27 / ``scale`` or more, whose distances need not fit a long. Fewer vectors than ``k``: as many
    centroids. Each row is a vector of its own, also if it repeats another or shares its id; a null id stays null
    and is hashed as an empty one. Equal vectors make centroids that tie: the smaller number wins, the other stays
    empty and in place. Inertia beyond a long is null. Other columns are ignored; an empty table gives no rows."""
    vectors = integer_vectors(df, id_col, vec_col, dims, scale)
    centroids = starting_centroids(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema)
    curve = Curve(centroids)
    basis = curve.basis
    table = blocks(vectors, curve, block)
    for _ in range(rounds):
        sums, counts, _ = assign_sums(table, centroids, basis)
        centroids = np.array([[s // n for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids, strict=True)], np.int64)
    far = assign_sums(table, centroids, basis)[2]

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = [np.frombuffer(i, np.int64) for i in b.column("ids").to_pylist()]
            for of, _, number, distance in compare(b, centroids, basis, False):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[i] for i in of.tolist()])), pa.array(number.astype(np.int32)),
                                                  pa.array(distance)], ["vec_id", "cluster", "distance"])

    def long(v: int):
        return F.lit(v if v < 1 << 63 else None).cast("long")

    facts = F.array(*[F.struct(long(v).alias("cluster_inertia"), F.array(*[F.lit(int(x)).cast("long") for x in c]).alias("centroid"))
                      for v, c in zip(far, centroids, strict=True)])
    found = table.mapInArrow(work, "vec_id long, cluster int, distance long").withColumn("_of", F.get(facts, F.col("cluster")))
    return found.select(exchange.restore_id("vec_id"), "cluster", "distance", "_of.cluster_inertia", long(sum(far)).alias("inertia"), "_of.centroid")


def op12_zone_clusters(spark, sf_dir):
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")


def _op12_sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    steps = [f"""
v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('{seed}:' || coalesce(cast(vec_id AS VARCHAR), '')) AS h, x
       FROM v ORDER BY h, x LIMIT {k}))"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT v.r, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': c.k}}) AS m
      FROM v CROSS JOIN c{n} c GROUP BY v.r)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT a.m.k AS k, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM a{n} a JOIN v USING (r)) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(q.x, c.x) AS x FROM c{n} c LEFT JOIN (
      SELECT k, list(cast((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY k) q ON q.k = c.k)""")
    return "WITH" + ",".join(steps) + f"""
SELECT v.vec_id, cast(a.m.k AS INTEGER) AS cluster, a.m.d AS distance, cast(sum(a.m.d) OVER (PARTITION BY a.m.k) AS BIGINT) AS cluster_inertia,
       cast(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.k = a.m.k"""


OP12_SQL = _op12_sql()


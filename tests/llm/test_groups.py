"""Operators 11 to 13: against plain versions, dense and hot groups, and their defined edge cases."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.brute import lower, words
from voxelspark.llm import links, prefixtrie, registry, simhash, zonemaps

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# --- 11: SimHash ------------------------------------------------------------------------------------------------------------------

def plain_fingerprint(t):
    w = words(lower(t or ""))
    own = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [0] * 64
    for s in own:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(own))


def plain_groups(fps, radius=4):
    """Root of each position of a list of fingerprints."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def simhash_rows(docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    root = plain_groups(fps)
    least = {}
    for r, (d, _) in zip(root, docs, strict=True):
        least[r] = min(least.get(r, d), d, key=lambda x: (x is not None, x))
    return sorted(((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(docs, fps, root, strict=True)), key=lambda r: tuple((x is not None, x) for x in r))


def digest11(df):
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")


def test_simhash_query(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    want = simhash_rows(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))
    assert rows_of(registry.QUERIES["op11_simhash_groups"](spark, SF)) == want


def test_simhash_odd_rows(spark):
    """Null ids and texts, no words, short and very long texts, equal rows, rows that share an id, clashing columns."""
    rnd = random.Random(1)
    long = " ".join(rnd.choices(["é", "Ab", "xyz", "日本"], k=700_000))
    t = " ".join(f"w{i}" for i in range(60))
    docs = [(5, None), (7, ""), (9, " \t\n"), (None, "one"), (3, "ONE"), (4, "a b c d"), (4, "A B\x0bC\nd"), (2, t), (2, t), (2, "shares an id only"), (1, long), (8, long + " end"), (6, t.upper())]
    df = spark.createDataFrame([(d, x, 1, "x", "y") for d, x in docs], "doc_id long, text string, fp int, slot string, component string")
    want = simhash_rows(docs)
    assert rows_of(digest11(simhash.simhash_groups(df))) == want
    got = {r[0]: r[2] for r in want}
    assert got[5] == got[7] == got[9] == 5 and got[3] is None and got[6] == 2      # no words: linked; null ids come first
    assert simhash.simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1000, 10 ** 7, 10 ** 10])
def test_dense_fingerprints_lose_no_link(spark, monkeypatch, n):
    """Balls of fingerprints around few centres, whose keys are hot: every plan finds every link."""
    rnd = random.Random(3)
    centres, fps = [rnd.getrandbits(64) for _ in range(3)], set()
    while len(fps) < 400:
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, 9)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    plan = simhash.plan(n)
    assert sum(r for _, _, r in plan) >= 1 and sum(b for _, b, _ in plan) == 64
    monkeypatch.setattr(simhash, "plan", lambda *_: plan)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash.links(df, 4, block=16)
    assert found.count() < 12 * len(fps) * len(plan)       # blocks give out forests, not pairs
    group = {r[0] % (1 << 64): r[1] for r in links.components(found).collect()}
    parts = {}
    for f in fps:
        parts.setdefault(group.get(f, f), set()).add(f)
    want = {}
    for f, r in zip(fps, plain_groups(fps), strict=True):
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_plan_covers_every_split_of_the_radius():
    for n in (10, 10 ** 6, 10 ** 9, 10 ** 12):
        for radius in (0, 1, 2, 3, 4, 5):
            plan = simhash.plan(n, radius)
            m = len(plan)

            def splits(left, parts):
                if parts == 0:
                    yield ()
                    return
                for x in range(left + 1):
                    for rest in splits(left - x, parts - 1):
                        yield (x, *rest)
            if sum(b for _, b, _ in plan) == 64:          # all segments have a table: each way to spread the bits is met
                assert all(any(x <= r for x, (_, _, r) in zip(s, plan, strict=True)) for s in splits(radius, m))


def test_one_text_and_its_links_within_a_task():
    group = np.zeros(6, np.int64)
    fp = np.array([0b0, 0b1, 0b11111111, 0b0, 0b1, 0b11111111], np.uint64)
    probe = np.array([False] * 3 + [True] * 3)
    u, v = simhash.linked(group, fp, probe, 1)
    assert list(zip(u.tolist(), v.tolist(), strict=True)) == [(1, 0)]


# --- 12: clusters -----------------------------------------------------------------------------------------------------------------

def plain_clusters(rows, k=8, rounds=10, seed=3, dims=64, scale=1024):
    import math
    v = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    c = [x for _, x in sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in v)[:k]]

    def assign():
        return [min((sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for _, x in v]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [x for (_, x), (_, n) in zip(v, at, strict=True) if n == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    far = [sum(d for d, n in at if n == j) for j in range(len(c))]
    return sorted(((i, n, d, far[n], sum(far), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(v, at, strict=True)),
                  key=lambda r: tuple((x is not None, x) for x in r))


def digest12(df):
    return df.withColumn("c", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")


def test_cluster_query(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    want = plain_clusters(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)), rounds=10)
    assert rows_of(registry.QUERIES["op12_zone_clusters"](spark, SF)) == want


@pytest.mark.parametrize("size", [1.0, 100_000.0])
def test_clusters_of_odd_vectors(spark, size):
    """Nulls, wrong lengths, non-finite values, a vector that a third of all rows share, ties, clashing columns, large values."""
    rnd = random.Random(5)
    hot = [size * rnd.uniform(-1, 1) for _ in range(4)]
    rows = [(i, [size * rnd.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(100 + i, hot) for i in range(40)]
    rows += [(7, hot), (7, hot), (None, [0.0, -0.0, size, 0.5]), (1000, None), (1001, [1.0]), (1002, [1.0, None, 1.0, 1.0]), (1003, [1.0, float("nan"), 1.0, 1.0]),
             (1004, [float("inf"), 1.0, 1.0, 1.0]), (1005, []), (1006, [1.0] * 5)]
    df = spark.createDataFrame([(i, e, "x", 3, b"k") for i, e in rows], "vec_id long, embedding array<double>, x string, n int, key binary")
    for k in (8, 3, 1, 200):
        got = zonemaps.cluster(df, k=k, rounds=4, dims=4, block=8)
        assert rows_of(digest12(got)) == plain_clusters(rows, k=k, rounds=4, dims=4)
    assert zonemaps.cluster(df.filter("vec_id > 1000"), dims=4).count() == 0


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        key = zonemaps.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_boxes_keep_every_nearest_centroid_and_drop_others():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-1000, 1000, (8, 16))
    x = (centroids[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 16)))
    curve = zonemaps.Curve(centroids)
    x = x[np.argsort(curve(x))]
    along = np.hstack([x, x @ curve.basis])
    first = np.arange(0, len(x), 16)
    may = zonemaps.candidates(np.minimum.reduceat(along, first), np.maximum.reduceat(along, first), centroids, curve.basis)
    best, distance = zonemaps.nearest(x, centroids)
    assert may[np.arange(len(x)) // 16, best].all() and may.mean() < 0.5
    assert (distance == ((x[:, None] - centroids) ** 2).sum(2).min(1)).all()


# --- 13: the trie -----------------------------------------------------------------------------------------------------------------

def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    def code(t):
        return hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()
    own = {c: [(r, x) for _, r, x in sorted(ts, key=lambda t: (t[0], code(t)))] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(built[c][:d], []).append(c)
    out = []
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(str(c) for c in members if len(built[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(kids.get(p, ())), sum(q not in kids for q in below),
                    sum((len(nodes[q]) - 1) * len(words(q[-1][1])) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def trie(df):
    return prefixtrie.prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_query(spark):
    t = pq.read_table(f"{SF}/conversations.parquet")
    rows = list(zip(*(t[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True))
    assert rows_of(registry.QUERIES["op13_prefix_trie"](spark, SF)) == plain_trie(rows)


def test_trie_of_odd_conversations(spark):
    """Null turns, roles and texts, ties, repeated rows, negative ids, copies that hold a third, a text of 3 MB, clashing columns."""
    rnd = random.Random(8)
    rows = []
    for c in range(90):
        for turn in range(rnd.randint(1, 5)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "hi there", "a b\tc\n"])))
    for c in range(200, 300):
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "same again"), (c, 2, "user", "more")]
    rows += [(400, None, None, None), (400, None, None, None), (400, 3, "user", None), (401, 1, "user", "x"), (401, 1, "assistant", "x"), (401, 1, "user", "x"),
             (None, 0, "user", "nobody's"), (-5, 0, "user", "below"), (-20, 0, "user", "zero"), (-20, 1, "user", ""), (500, 0, "user", "y " * 1_500_000),
             *[(540, t, "user", f"a b {t % 3}") for t in range(40)], *[(541, t, "user", f"a b {t % 3}") for t in range(40)],
             *[(560, t, "user", f"a b {t % 3}" + "!" * (t > 30)) for t in range(40)], *[(580, t, "user", f"a b {t % 3}") for t in range(35)],
             (500, 1, "u:ser", "1:a"), (501, 0, "u", ":ser1:a"), (520, 0, "user", "only"), (521, 0, "user", "one"), (522, 0, "user", "turn")]
    df = spark.createDataFrame([(*r, "x", 1, b"p") for r in rows], "conv_id long, turn long, role string, text string, pos string, code int, path binary")
    got = trie(df.repartition(7))
    assert rows_of(got) == plain_trie(rows)
    assert prefixtrie.prefix_trie(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn long, role string, text string")     # h = 3: no turns are left
    assert rows_of(trie(lone)) == plain_trie([(1, 0, "user", "hello")])


def test_long_classes_are_hashed_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(c, 0, "user", "same") for c in range(1, 60)], "conv_id long, turn long, role string, text string")
        want = plain_trie([(c, 0, "user", "same") for c in range(1, 60)])
        assert rows_of(trie(df)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

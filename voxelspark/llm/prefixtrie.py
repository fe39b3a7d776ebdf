"""Operator 13: trie of conversation prefixes by truncation peeling.

A conversation becomes its path: a code of fixed width for each turn. Starting at the
greatest depth that two paths share, the conversations that end there join the nodes that survived from the depth
below, equal paths are merged into the nodes of this depth with all their figures summed up,
each node's last turn is stripped, and what is left goes on to the next depth. Every node is
found once and is complete when it is found.

Conversations with one path are one row from the start. Grouping adds numbers only, so it is
combined before each shuffle; a prefix that a third of all conversations share is one row a task.
"""
from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.llm import exchange

GROUP, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
CODE = 20                       # bytes of a turn's code: 16 of a digest of role and text, 4 for its number of words
_CLASSES = pa.schema([("path", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends_sha256", pa.string())])
CLASSES = "path binary, depth int, conv_id long, n_convs long, ends_sha256 string"
_NO_END = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """``conv_id, pos, code``: each turn's place from 1 and its code in hex; texts go no further than this."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0")
    coded = df.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(F.substring(digest, 1, 2 * CODE - 8), words).alias("code"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "code")
    return coded.select("conv_id", F.row_number().over(order).alias("pos"), "code")


def paths(df: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``conv_id, path`` of every rebuilt conversation: the first turns of its group's first one, then its own others."""
    ranked = exchange.cut_lineage(turns(df))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    own = ranked.filter((F.col("pos") > h) | (F.col("pos") == 1)).select(
        "conv_id", F.lit(1).alias("part"), "pos", F.when(F.col("pos") > h, F.col("code")).otherwise("").alias("code"))
    first = ranked.filter((F.col("pos") < heads) & (base == F.col("conv_id"))).select(F.col("conv_id").alias("base"), "pos", "code")
    asks = ranked.filter("pos = 1").select("conv_id", base.alias("base"), h.alias("h"))
    lent = asks.join(first, "base").filter("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "code")
    gathered = own.unionByName(lent).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "code"))).alias("t"))
    return gathered.select("conv_id", F.unhex(F.array_join(F.col("t.code"), "")).alias("path"))


def classes(routes: DataFrame) -> DataFrame:
    """``path, depth, conv_id, n_convs, ends_sha256``: conversations with one path as one row.

    Ids come sorted and are hashed as they pass, so a class of any size needs no memory."""
    def gather(batches):
        path, hasher, least, n = None, None, 0, 0

        def row():
            return path, len(path) // CODE, least, n, hasher.hexdigest()

        for b in batches:
            done = []
            for p, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if p == path:
                    hasher.update(b",%d" % c)
                    n += 1
                    continue
                if path is not None:
                    done.append(row())
                path, hasher, least, n = p, hashlib.sha256(b"%d" % c), c, 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done, strict=True), _CLASSES, strict=True)], schema=_CLASSES)
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(), _CLASSES, strict=True)], schema=_CLASSES)

    return routes.select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(gather, CLASSES)


def shared_depths(ended: DataFrame) -> DataFrame:
    """``conv_id, shared``: how many turns of a class's path another class has too. One row a turn is shuffled, its key."""
    def prefixes(batches):
        for b in batches:
            conv, depth, keys = [], [], []
            for path, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                key = b""
                for d in range(len(path) // CODE):
                    key = hashlib.blake2b(key + path[d * CODE:(d + 1) * CODE], digest_size=16).digest()
                    keys.append(key)
                conv += [c] * (len(path) // CODE)
                depth += range(1, len(path) // CODE + 1)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int32()), pa.array(keys, pa.binary())], ["conv_id", "d", "key"])

    each = ended.select("path", "conv_id").mapInArrow(prefixes, "conv_id long, d int, key binary")
    met = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return each.join(met, "key").groupBy("conv_id").agg(F.max("d").alias("shared"))


def _words_after(path: bytes) -> np.ndarray:
    """Summed words of each turn and all after it, and zero."""
    words = np.frombuffer(path, np.uint8).reshape(-1, CODE)[:, CODE - 4:].copy().view(">u4").ravel().astype(np.int64)
    return np.append(np.cumsum(words[::-1])[::-1], 0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _starts(batches):
    """Each class where it meets others: as it ended there, or with what its own last turns add up to."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            depth, s, n = len(r["path"]) // CODE, r["shared"], r["n_convs"]
            end = depth == s
            rows.append((r["path"][:s * CODE], s, r["conv_id"], n, int(not end), int(not end), 0 if end else (n - 1) * int(_words_after(r["path"])[s]),
                         r["ends_sha256"] if end else None))
        if rows:
            yield _batch(rows, _STARTS)


def _tails(batches):
    """The nodes that only one class has."""
    rows = []
    for b in batches:
        for r in b.to_pylist():
            depth, s, n = len(r["path"]) // CODE, r["shared"], r["n_convs"]
            after = _words_after(r["path"]).tolist()
            rows += [(r["path"][:s * CODE] if d == s + 1 else None, r["conv_id"], d, n, int(d < depth), 1, (n - 1) * after[d - 1],
                      r["ends_sha256"] if d == depth else _NO_END) for d in range(s + 1, depth + 1)]
            if len(rows) >= 4096:
                yield _batch(rows, _NODES)
                rows = []
    if rows:
        yield _batch(rows, _NODES)


_STARTS = pa.schema([("path", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("children", pa.int64()),
                     ("leaves", pa.int64()), ("saved", pa.int64()), ("ends_sha256", pa.string())])
STARTS = "path binary, conv_id long, n_convs long, children long, leaves long, saved long, ends_sha256 string, depth int"
_NODES = pa.schema([("up", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
NODES = "up binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(df: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row a node; ``conv_id`` (smallest member) and ``depth`` tell nodes apart.

    Depths are peeled one after the other as far down as two different conversations share turns; turns below belong to one
    path and are given out at once. Turns are ordered by ``turn``, a null one first, equal ones by a digest of their contents;
    equal rows are turns of their own. Null roles and texts are empty, a text of any length enters as its digest and number of
    words. Turns without a ``conv_id`` belong to no conversation and are left out. The turn codes of one conversation (20 bytes
    each) are gathered in a row. Other columns are ignored; an empty table gives no nodes, not even a root."""
    spark = df.sparkSession
    folder = f"{exchange.shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    ended = exchange.cut_lineage(classes(paths(df, group, heads)))
    routes = exchange.cut_lineage(ended.join(shared_depths(ended), "conv_id", "left").select(
        "path", "conv_id", "n_convs", "ends_sha256", F.coalesce("shared", F.lit(0)).alias("shared")))
    routes.mapInArrow(_starts, "path binary, depth int, conv_id long, n_convs long, children long, leaves long, saved long, ends_sha256 string").write.partitionBy(
        "depth").parquet(f"{folder}/starts")
    starts = spark.read.schema(STARTS).parquet(f"{folder}/starts")
    deepest = starts.agg(F.max("depth")).first()[0]
    zero, levels, written = F.lit(0).cast("long"), [], None
    for d in range(-1 if deepest is None else deepest, -1, -1):
        rows = starts.filter(F.col("depth") == d).drop("depth")
        if levels:
            rows = rows.unionByName(spark.read.schema(written).parquet(levels[-1]).select(
                F.substring("path", 1, CODE * d).alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("children"),
                F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends_sha256")))
        nodes = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("children").alias("n_children"),
                                         F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends_sha256").alias("ends_sha256"))
        words = F.conv(F.hex(F.substring("path", CODE * d - 3, 4)), 16, 10).cast("long") if d else zero
        nodes = nodes.select("path", F.lit(d).cast("long").alias("depth"), "conv_id", "n_convs", "n_children",
                             F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * words).alias("saved_tokens"),
                             F.coalesce("ends_sha256", F.lit(_NO_END)).alias("ends_sha256"))
        levels.append(f"{folder}/{d}")
        nodes.write.parquet(levels[-1])
        written = nodes.schema
    if not levels:
        return spark.createDataFrame([], f"parent_conv_id long, {NODES}").drop("up")
    met = spark.read.schema(written).parquet(*levels)
    up = F.expr(f"substring(path, 1, {CODE} * (cast(depth AS int) - 1))")
    met_rows = met.withColumn("up", F.when(F.col("depth") > 0, up)).select("up", *_NODES.names[1:])
    tails = routes.filter(F.length("path") > CODE * F.col("shared")).mapInArrow(_tails, NODES)
    parents = met.filter("n_children > 0").select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    top = met_rows.unionByName(tails.filter("up IS NOT NULL")).join(parents, "up", "left")
    below = tails.filter("up IS NULL").withColumn("parent_conv_id", F.col("conv_id"))
    return top.unionByName(below).drop("up")


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_STEPS = ", ".join(["-1"] * 8)
OP13_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role,
                  coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base, xor(4294967295, list_reduce(flatten(list_transform(
             string_split(cast(conv_id AS VARCHAR), ''), lambda b: [ascii(b)::BIGINT, {_STEPS}])), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e)
             ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
part AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
         UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
seq AS (SELECT c.conv_id, coalesce(s.p, []) AS p FROM c LEFT JOIN (
        SELECT conv_id, list({{'r': role, 't': text}} ORDER BY part, pos) AS p FROM part GROUP BY conv_id) s USING (conv_id)),
m AS (SELECT conv_id, p[1:d] AS p, d, len(p) AS n FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM seq)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
                CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(p[d].t), '[^\\x20\\x09-\\x0D]+')) END AS words FROM m GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.k, 0) AS n_children FROM node LEFT JOIN kids USING (p, d)),
tree AS (SELECT p[1:a] AS p, a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
         FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY 1, 2)
SELECT f.conv_id, cast(f.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, f.n_convs, cast(f.n_children AS BIGINT) AS n_children,
       cast(tree.n_leaves AS BIGINT) AS n_leaves, cast(tree.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN tree USING (p, d) LEFT JOIN node o ON f.d > 0 AND o.d = f.d - 1 AND o.p = f.p[1:f.d - 1]"""

"""Every operator against a plain version on the smallest tables and on hand-made ones, and its defined edge cases."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tests.llm import brute
from voxelspark.llm import (decontaminate, exchange, factors, forest, katz, licences, linejoin, links, packing, quality,
                            registry, sequences, suffixes, text, windows)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, data string, key int"
BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (5, "short item")]


def made() -> list[tuple[int, str]]:
    """Copies, near copies, shared passages, short, empty, long and odd texts."""
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ß#", "日本", "A", "a."]

    def prose(n):
        out = []
        while n > 0:
            k = min(n, rnd.randint(1, 25))
            out.append(" ".join(rnd.choices(vocab, k=k)))
            n -= k
        return "\n".join(out)
    base, passage = prose(200), prose(70)
    docs = [base] * 3
    for _ in range(6):
        w = base.split(" ")
        for _ in range(rnd.randint(1, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append(" ".join(w))
    docs += [prose(rnd.randint(5, 80)) + "\n" + passage + "\n" + prose(rnd.randint(5, 80)) for _ in range(6)]
    docs += [None, "", " \n\t ", "one", "a b c d", "a b c d", "aaaa" * 80, "x y " * 300, "\n".join(["same line of six words here"] * 5)]
    docs += ["Zero ONE two, three four-five six seven eight nine ten eleven!", "a short, item", prose(6000), "b" * 5000]
    docs += [prose(rnd.randint(1, 120)) for _ in range(20)]
    return [(7 * i % 1009, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def small():
    t = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["source"].to_pylist(), strict=True))


@pytest.fixture(scope="module")
def hand(spark):
    docs = made()
    rows = [(d, t, "en", ("h1", None)[d % 2], 1, "clash", "clash", 1) for d, t in docs]
    return docs, spark.createDataFrame(rows, SCHEMA).repartition(5)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def digest10(df):
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return df.select("doc_id", "n_bytes", size, F.size("spans").cast("long"), F.sha2("kept", 256))


def digest9(df):
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return df.select("doc_id", "n_words", size, F.sha2(F.col("kept").cast("binary"), 256))


def digest5(df):
    return df.select("doc_id", "n_lines", F.size("removed").cast("long"), F.array_join("removed", ","))


def digest1(df):
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ",").cast("binary"), 256),
                     F.col("n_hit") > 0)


def digest8(df):
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def digest7(df):
    return df.select("doc_id", F.size("found"))


OPERATORS = {
    "hits": lambda spark, df: digest1(decontaminate.decontaminate(df, bench(spark))),
    "tokens": lambda spark, df: sequences.read_tokens(sequences.write_tokens(df, sequences.token_folder(spark))),
    "katz": lambda spark, df: katz.katz_scores(df),
    "near": lambda spark, df: forest.near_duplicates(df, 85),
    "lines": lambda spark, df: digest5(linejoin.similar_lines(df)),
    "packing": lambda spark, df: packing.pack(df),
    "licences": lambda spark, df: digest7(licences.licences(df)),
    "quality": lambda spark, df: digest8(quality.quality(df)),
    "words": lambda spark, df: digest9(factors.remove_repeated_words(df)),
    "bytes": lambda spark, df: digest10(suffixes.remove_repeated_bytes(df)),
}


# --- against plain versions -------------------------------------------------------------------------------------------------

def plain(name, docs, hosts, items):
    return {"hits": lambda: brute.benchmark_hits(docs, items), "tokens": lambda: brute.token_files(docs),
            "near": lambda: brute.near_groups(docs), "lines": lambda: brute.similar_lines(docs),
            "quality": lambda: brute.quality([(d, t, h) for (d, t), h in zip(docs, hosts, strict=True)]),
            "words": lambda: brute.repeated_words(docs), "bytes": lambda: brute.repeated_bytes(docs)}[name]()


@pytest.mark.parametrize("name", ["hits", "tokens", "near", "lines", "quality", "words", "bytes"])
def test_hand_made(spark, hand, name):
    docs, df = hand
    assert rows_of(OPERATORS[name](spark, df)) == sorted(plain(name, docs, [("h1", None)[d % 2] for d, _ in docs], BENCH))


@pytest.mark.parametrize("op,name", [("op1_benchmark_hits", "hits"), ("op2_token_files", "tokens"), ("op4_forest_groups", "near"),
                                     ("op5_similar_lines", "lines"), ("op8_line_frequency", "quality"), ("op9_lz_dedup", "words"),
                                     ("op10_suffix_dedup", "bytes")])
def test_registered_query(spark, small, op, name):
    b = pq.read_table(f"{SF}/benchmark.parquet")
    items = list(zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True))
    want = plain(name, [(d, t) for d, t, _ in small], [h for _, _, h in small], items)
    assert rows_of(registry.QUERIES[op](spark, SF)) == sorted(want)


def close(got, want):
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_katz_query_beats_its_base_on_held_out_documents(spark, small):
    want, (prob, words, contexts) = brute.katz([(d, t) for d, t, _ in small])
    got = rows_of(registry.QUERIES["op3_katz_scores"](spark, SF))
    close(got, want)
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)
    for u in list(contexts)[:20]:                        # exactly normalised, the unknown word included
        assert sum(prob(w, u) for w in words) + prob("never seen", u) == pytest.approx(1, abs=1e-9)


def test_katz_hand_made(spark, hand):
    docs, df = hand
    close(rows_of(OPERATORS["katz"](spark, df)), brute.katz(docs)[0])


def check_packing(rows, docs, length=2048):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), length)):
            own = ids[at:at + length]
            want.append((d, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(r[:5] for r in rows) == sorted(want)
    sequences_ = {}
    for r in rows:
        sequences_.setdefault(r[5], []).append((r[6], r[3]))
    for places in sequences_.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences_), sum(w[3] for w in want)


def test_packing_query(spark, small):
    n, tokens = check_packing(rows_of(registry.QUERIES["op6_pattern_packing"](spark, SF)), [(d, t) for d, t, _ in small])
    assert n <= -(-tokens // 2048) + 1


def test_packing_hand_made(spark, hand):
    docs, df = hand
    check_packing(rows_of(OPERATORS["packing"](spark, df)), docs)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    chosen = packing.plan(counts, 64)
    used = np.zeros(65, np.int64)
    for runs, many in chosen:
        assert sum(size * copies for size, copies in runs) <= 64
        for size, copies in runs:
            used[size] += copies * many
    assert (used == counts).all()
    assert sum(many for _, many in chosen) <= 1.005 * sum(many for _, many in packing.best_fit(counts, 64))


def test_fit_is_non_negative_and_close():
    counts = np.zeros(11, np.int64)
    counts[[2, 3, 5, 8]] = 40, 20, 40, 20
    rows = np.concatenate([packing.patterns(counts, 10, k) for k in (2, 3)])
    x = packing.fit(rows, counts)
    assert (x >= 0).all() and np.abs(packing.usage(rows, x, 11) - counts).max() < 3


def test_encoder_agrees_with_the_library():
    from voxelspark.llm import tokens
    enc = tokens.Encoder()
    texts = [t or "" for _, t in made()] + ["<|endoftext|> a<|startoftext|>b", "e\u0301 \u0301x \u00a0y\tz  \r\n", "x" * 200 + " don't I'LL \u0130\u03a3 \ufb01", "\u3000 \x1c\x85q", "Word, next. End", ".", ", ",
              "a.", " .b c... d,, e., f,\ng.\n", "A, <|STARTOFTEXT|>, B.", "I\u0307, x\u0301. y", "é, ß. 日, 3, 4. ", "it's, don't. 's. "]
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc(pa.array(texts)) == want and enc(pa.array(texts)) == want
    assert enc(pa.array(texts).slice(3, 4)) == want[3:7]


# --- defined edge cases ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_and_repeated_rows(spark, name):
    """Null ids and texts, equal rows, rows that share an id: a result row each, ids kept, and twice the same."""
    t = "some words that are said again and again in this text of twenty words or more so that it is long enough"
    rows = [(None, None), (None, t), (3, t), (3, t), (3, "other"), (4, None), (4, ""), (5, t + " x"), (2, "other")]
    df = spark.createDataFrame([(d, x, None, None, None, None, None, None) for d, x in rows], SCHEMA)
    got = OPERATORS[name](spark, df)
    key = lambda r: tuple((x is not None, x) for x in r)
    first, second = (sorted((tuple(r) for r in x.drop("sequence_id", "offset").collect()), key=key) for x in (got, OPERATORS[name](spark, df)))
    assert first == second
    assert sorted((r[0] is not None, r[0]) for r in first) == sorted((d is not None, d) for d, _ in rows)
    if name in ("words", "bytes"):                       # equal rows do not remove each other, null ids come first
        assert [r[2] for r in first if r[0] == 3] == [0, *[len(t.split()) if name == "words" else len(t)] * 2]
    if name == "near":
        assert all(r[3] == (r[0] is None) for r in first if r[1] > 1 and r[0] in (None, 3, 5))


def test_larger_benchmark_is_cut_into_automata(spark, hand):
    docs, df = hand
    got = digest1(decontaminate.decontaminate(df, bench(spark), shard_chars=40))
    assert rows_of(got) == sorted(brute.benchmark_hits(docs, BENCH))


def test_hits_map_back_to_the_original(spark):
    t = "É! Zero ONE two, three four-five six seven eight nine ten eleven; end"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "zero one two three four five six seven eight nine")], "item_id long, text string")
    r = decontaminate.decontaminate(df, items).first()
    assert [t[s["start"]:s["end"]] for s in r["spans"]] == ["Zero ONE two, three four-five six seven eight nine"]


def test_token_file_is_random_access(tmp_path):
    doc, sizes = np.array([3, 5, 9]), np.array([4, 700, 3])
    ids = np.arange(707, dtype=np.uint16)
    sequences.write_file(f"{tmp_path}/a.arrow", ids, sizes, doc, 64)
    with sequences.Tokens(f"{tmp_path}/a.arrow") as t:
        row, mask = t.sequence(2)
        assert row.to_pylist() == list(range(128, 192)) and all(mask.to_pylist())
        assert row.buffers()[1].address != 0 and sum(t.sequence(11)[1].to_pylist()) == 707 - 11 * 64
        assert t.span(4, 700).tolist() == list(range(4, 704))
        assert t.index["doc_id"].to_pylist() == [3, 5, 9]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 301)]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


def test_dense_regions_are_cut_deeper(spark, monkeypatch):
    rnd = random.Random(1)
    base = [f"t{i}" for i in range(300)]
    docs = []
    for d in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(300)] = f"z{rnd.random()}"
        docs.append((d, " ".join(w)))
    monkeypatch.setattr(forest, "REGION", 8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(forest.near_duplicates(df, 85)) == sorted(brute.near_groups(docs))


def test_large_regions_lose_no_pair(spark, monkeypatch):
    """A chain in which only neighbours are alike: one lost pair cuts it."""
    rnd = random.Random(4)
    w = [f"t{rnd.random()}" for _ in range(200 * 23 + 300)]
    docs = [(d, " ".join(w[23 * d:23 * d + 300])) for d in range(200)]
    monkeypatch.setattr(forest, "REGION", 2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(forest.near_duplicates(df, 85))
    assert {r[2] for r in got} == {0} and got == sorted(brute.near_groups(docs))


def test_neighbours_follow_the_order_of_their_tree():
    sig = np.zeros((4, forest.HASHES), np.uint16)
    sig[:, 0] = 0, 1, 2, 3                               # tree 0 has them in this order
    sig[:, 8:16] = [[5] * 8, [5] * 3 + [9] * 5, [5] * 7 + [6], [5] * 4 + [8] * 4]
    got = {int(i): near.tolist() for i, near in forest.neighbours(1, np.arange(4), sig, 0)}
    assert got == {0: [2, 3], 2: [3, 1], 3: [1], 1: []}


def test_every_unconnected_pair_of_a_large_region_meets_once(spark, monkeypatch):
    monkeypatch.setattr(forest, "REGION", 4)
    rows = [(7, d, 30, 1 if d < 12 else d // 2) for d in range(30)] + [(8, d, 3, d) for d in range(3)] + [(9, d, 9, 5) for d in range(9)]
    df = spark.createDataFrame(rows, "region long, doc long, n long, component long")
    met, slots = [], {}
    for r in forest.block_pairs(df).collect():
        slots.setdefault(r["region"], []).append(r)
    for group in slots.values():
        met += [tuple(sorted((a["doc"], b["doc"]))) for i, a in enumerate(group) for b in group[i + 1:]
                if a["component"] != b["component"] and (not a["side"] or a["side"] != b["side"])]
    want = [(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1:] if a[0] == b[0] and a[3] != b[3]]
    assert sorted(met) == sorted(want)


def test_previous_factors():
    s = np.frombuffer(b"abracadabra abracadabra banana", np.uint8)
    start = np.arange(len(s))
    order, lcp = suffixes.suffix_order(np.r_[s, np.zeros(40, np.uint8)], start, start, len(s))
    factor, source = suffixes.previous_factors(start[order], lcp)
    raw = bytes(s) + bytes(40)
    for rank, p in enumerate(start[order].tolist()):
        best = 0
        for q in range(p):
            k = 0
            while k < len(s) and raw[p + k] == raw[q + k]:
                k += 1
            best = max(best, k)
        assert factor[rank] == best
        if best:
            assert start[order][source[rank]] < p


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 100, 4000).astype(np.uint8)
    bounds = np.array([0, 0, 50, 1500, 1500, 3999, 4000])
    of, first, count, rel, _, _ = windows.segments(text.Hashes(buf), bounds, 100, 32)
    starts = sorted(int(bounds[t]) + int(f) + k for t, f, c in zip(of, first, count, strict=True) for k in range(c))
    assert starts == [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b - 99)]


def test_very_long_text_is_cut_with_overlap(monkeypatch):
    rng = np.random.default_rng(6)
    buf = rng.integers(97, 123, 5000).astype(np.uint8)
    whole = windows.segments(text.Hashes(buf), np.array([0, 5000]), 100, 32)
    monkeypatch.setattr(windows, "_PLACE", 11)
    parts = windows.segments(text.Hashes(buf), np.array([0, 5000]), 100, 32)
    assert parts[2].sum() == whole[2].sum() == 4901
    assert len(set(parts[4].tolist()) ^ set(whole[4].tolist())) <= 6


def test_licences(spark):
    docs = [(1, "Foo bar. Licensed under the Apache License, Version 2.0. More prose " + "x " * 50), (2, "the MIT way of licence is not one"),
            (3, "This work is licenced under the GNU general public license,\nversion 3. Released under the MIT License."), (4, None)]
    got = {r["doc_id"]: r for r in licences.licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(f["licence"], f["exact"]) for f in got[1]["found"]] == [("Apache-2.0", True)]
    assert docs[0][1][got[1]["found"][0]["start"]:got[1]["found"][0]["end"]] == "Licensed under the Apache License, Version 2.0"
    assert got[2]["found"] == [] and got[2]["n_blocks"] == 1
    assert [(f["licence"], f["exact"], f["differences"]) for f in got[3]["found"]] == [
        ("GPL-3.0", False, ["replace: licensed -> licenced"]), ("MIT", True, [])]
    assert got[4]["n_blocks"] == 0


def scan(s):
    return [(f["licence"], f["exact"]) for f in licences.scan_text(s, licences.Templates(licences.TEMPLATES), licences.re.compile(licences.CUE, licences.re.I),
                                                                   licences.DIFFER)[1]]


@pytest.mark.parametrize("notice,name", [
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivs 4.0 International License.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None),
    ("This work is licensed under the GNU General Public License, version 1.", None),
    (licences._BSD2, "BSD-2-Clause"), (licences._BSD3, "BSD-3-Clause"), (licences._BSD + " you ask first", "BSD"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
     "the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("Licensed under CC0 1.0.", "CC0-1.0")])
def test_licence_names_are_not_confused(notice, name):
    for s in (notice, "x y z " * 30 + notice + " some prose" * 200):
        assert scan(s) == ([(name, True)] if name else [])


def test_every_template_finds_itself():
    for name, wording in licences.TEMPLATES:
        assert (name, True) in scan(wording)


def test_licence_query_tells_differences(spark, tmp_path):
    docs = [(1, "This work is licenced under the GNU General Public License, version 3."), (2, "Released under the MIT License."), (3, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(registry.QUERIES["op7_licence_scan"](spark, str(tmp_path)).select("doc_id", "exact", "differences")) == [
        (1, False, "GPL-3.0 replace: licensed -> licenced"), (2, True, ""), (3, None, "")]


def test_licence_query(spark, small):
    phrases = {"Apache-2.0": "licensed under the apache license, version 2.0", "MIT": "released under the mit license",
               "GPL-3.0": "this work is licensed under the gnu general public license, version 3", "CC-BY-NC-4.0": "licensed under cc by-nc 4.0"}
    want = [(d, ",".join(sorted(k for k, p in phrases.items() if p in t.lower()))) for d, t, _ in small]
    assert [(r[0], r[2]) for r in rows_of(registry.QUERIES["op7_licence_scan"](spark, SF))] == sorted(want)


def test_copies_do_not_make_template_lines(spark):
    rnd = random.Random(2)
    line = lambda n: " ".join(f"v{rnd.randrange(5000)}" for _ in range(n))
    docs = [(i, "menu home about contact\n" + line(30)) for i in range(60)]
    docs += [(100 + i, "one clean text that was copied very often\n" + "and has a second line of words too") for i in range(40)]
    docs += [(200 + i, "menu home about contact\n" + line(6)) for i in range(3)]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert all(got[d]["kept"] for d, _ in docs if d < 200) and got[100]["template_lines"] == []
    assert got[0]["template_lines"] == [0] and not got[200]["kept"]


# --- the pipeline ---------------------------------------------------------------------------------------------------------------

def test_pipeline_against_plain_stages(spark, small):
    docs = [(d, t, h) for d, t, h in small]
    verdict = {r[0]: r for r in brute.quality(docs)}
    lines = {}
    for d, t, h in docs:
        for x in {" ".join(brute.words(brute.lower(x))) for x in t.split("\n")} - {""}:
            lines.setdefault((h, x), set()).add(" ".join(brute.words(brute.lower(t))))
    gone = {k for k, v in lines.items() if len(v) >= 20}
    now = [(d, "\n".join(x for x in t.split("\n") if (h, " ".join(brute.words(brute.lower(x)))) not in gone)) for d, t, h in docs if verdict[d][-1]]
    cut = {r[0]: {int(k) for k in r[3].split(",") if k} for r in brute.similar_lines(now)}
    left = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[d]), bool(cut[d])) for d, t in now]
    now = [(d, t) for d, t, changed in left if not changed or len(brute.words(t)) >= corpus_pipeline.MIN_WORDS]
    stay = {r[0] for r in brute.near_groups(now, forest.PERCENT) if r[3]}
    b = pq.read_table(f"{SF}/benchmark.parquet")
    items = list(zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True))
    now = [(d, t) for d, t in now if d in stay]
    now = [(d, t) for (d, t), r in zip(now, brute.benchmark_hits(now, items), strict=True) if not r[-1]]
    n, tokens = check_packing(rows_of(corpus_pipeline.run(spark, SF)), now)
    assert n <= -(-tokens // 2048) + 1


def test_template_lines_go_from_small_and_hot_hosts(spark):
    """The same line in as many documents of a small and of a hot host, and one in too few of the hot one."""
    rnd = random.Random(3)
    line = lambda n: " ".join(f"v{rnd.randrange(5000)}" for _ in range(n))
    docs = [(1000 * (h == "hot") + i, ("menu home about contact\n" if i < 30 else "seldom said words\n" if i < 49 else "") + line(30), h)
            for h, n in (("small", 60), ("hot", 600)) for i in range(n)]
    df = spark.createDataFrame([(d, t, "en", h, 1, "x") for d, t, h in docs], "doc_id long, text string, lang string, source string, n_chars long, slot string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, df, SF).collect()}
    assert got == {d: t.removeprefix("menu home about contact\n") for d, t, _ in docs}


def test_rows_that_share_an_id_keep_their_own_text(spark):
    """Text that is said once stays, whatever goes from another row with its id; and twice the same."""
    shared = " ".join(f"s{i}" for i in range(40))
    lone = " ".join(f"u{i}" for i in range(30))
    rows = [(1, shared), (3, shared), (3, lone), (3, lone[:40] + "\n" + shared), (None, lone + " more"), (None, "another text that is said once " * 3)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row string")
    got = sorted(map(tuple, factors.remove_repeated_words(df).select("doc_id", "kept").filter("doc_id = 3").collect()))
    assert got == [(3, ""), (3, ""), (3, " ".join(lone[:40].split()))]      # the null id is smaller: its copy of the 30 words stays
    alone = df.filter("doc_id is not null")
    assert sorted(r["kept"] for r in factors.remove_repeated_words(alone).filter("doc_id = 3").collect()) == sorted(["", lone, lone[:40].strip()])
    kept = sorted(bytes(r["kept"]) for r in suffixes.remove_repeated_bytes(alone).filter("doc_id = 3").collect())
    assert kept == sorted([b"", lone.encode(), (lone[:40] + "\n").encode()])
    removed = sorted(tuple(r["removed"]) for r in linejoin.similar_lines(alone).filter("doc_id = 3").collect())
    assert removed == [(), (0,), (1,)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key0 string"
    docs = spark.createDataFrame([(d, t, None, None, 1, "x") for d, t in rows if d], schema)
    for stage, want in ((corpus_pipeline.line_dedup, {lone, shared}), (corpus_pipeline.near_dedup, {lone, shared})):
        first, second = (sorted(map(tuple, stage(spark, docs, SF).collect()), key=str) for _ in range(2))
        assert first == second and want <= {r[1] for r in first} and {r[5] for r in first} == {"x"}
    hit = spark.createDataFrame([(1, BENCH[0][1] + " zero"), (1, lone)], "doc_id long, text string")
    corpus_pipeline_items = decontaminate.decontaminate(hit, bench(spark)).collect()
    assert sorted(r["n_hit"] > 0 for r in corpus_pipeline_items) == [False, True]


def test_pipeline_stages_survive_odd_tables(spark):
    """Nulls, equal rows, an extra column, nothing at all; one of equal rows stays."""
    t = "a text of more than ten words that is said once and has no copies here at all"
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string"
    rows = [(None, None, None, None, None, "x"), (1, t, "en", "s", 3, "x"), (1, t, "en", "s", 3, "x"), (2, "", None, None, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = exchange.cut_lineage(stage(spark, docs, SF))
            assert docs.columns == [f.name for f in T._parse_datatype_string(schema)]
        assert [r["doc_id"] for r in docs.collect()] == ([1] if data else [])
        corpus_pipeline.best_fit_packing(spark, docs, SF).collect()


def test_katz_records_are_squeezed_and_come_back():
    """Steps, small counts and homes of sorted asks: well under half the bytes of their columns."""
    rnd = np.random.default_rng(3)
    n = 20_000
    slot = rnd.integers(0, 7, n)
    cols = {k: rnd.integers(0, 4, n).astype(d) for k, d in katz.ASK.dtypes.items()} | {"low": rnd.integers(0, 1 << 32, n).astype(np.uint32)}
    packed = katz.ASK.pack(slot, cols)
    assert sum(map(len, packed.column("data").to_pylist())) < n * katz.ASK.width / 2
    back, order = katz.ASK.unpack(packed), np.argsort(slot, kind="stable")
    for k, d in katz.ASK.dtypes.items():
        assert back[k].dtype == d and (back[k] == cols[k][order]).all()
    weights = {k: rnd.random(n).astype(d) for k, d in katz.CONTEXT.dtypes.items()}
    back = katz.CONTEXT.unpack(pa.Table.from_batches([katz.CONTEXT.pack(slot, weights)] * 2))
    assert all((back[k] == np.tile(weights[k][order], 2)).all() for k in weights)
    assert all(len(v) == 0 for v in katz.ASK.unpack(katz.ASK.empty()).values())


def test_katz_whole_model(spark, hand):
    docs, df = hand
    close(rows_of(katz.katz_scores(df, min_pair=1)), brute.katz(docs, min_pair=1)[0])


def test_bitmaps_tell_long_unlike_lines_apart():
    """Lines of 180 words with a third in common are left out; a bitmap never differs by more bits than sets by words."""
    rnd = np.random.default_rng(5)
    pool = rnd.integers(0, 1 << 32, 3000).astype(np.uint64)
    for size, common, all_out in ((180, 60, True), (180, 175, False), (12, 9, False), (400, 390, False)):
        need, out = -(-80 * 2 * size // 180), []
        for _ in range(200):
            words = rnd.permutation(pool)[:2 * size - common]
            h = np.concatenate([words[:size], words[size - common:]])
            bits, more = linejoin.bitmaps(h, np.array([0, size, 2 * size]))
            apart = int(np.bitwise_count(bits[0] ^ bits[1]) + np.bitwise_count(more[0] ^ more[1]))
            assert apart <= 2 * (size - common)
            out.append(apart > 2 * size - 2 * need)
        assert not all_out or sum(out) > 150


def test_wide_bitmaps_tell_lines_of_hundreds_of_words_apart():
    """Bitmaps of all lines let unlike lines of 300 words pass; wide ones don't, whatever widths meet, and never differ by more bits than sets by words."""
    rnd = np.random.default_rng(6)
    pool = rnd.integers(0, 1 << 32, 5000).astype(np.uint64)
    for one, two, common, all_out in ((300, 300, 60, True), (300, 410, 0, True), (150, 180, 20, True), (380, 420, 375, False), (120, 120, 110, False)):
        need, out = -(-80 * (one + two) // 180), []
        for _ in range(100):
            words = rnd.permutation(pool)[:one + two - common]
            h = np.concatenate([words[:one], words[one - common:]])
            at = np.array([0, one, one + two])
            flat, width = linejoin.wide_bitmaps(h, at)
            start, to = np.array([0, width[0]]), int(width.min())
            x, y = (linejoin.fold(flat, start[k:k + 1], width[k:k + 1], to) for k in (0, 1))
            apart = int(np.bitwise_count(x ^ y).sum())
            assert to and apart <= one + two - 2 * common
            out.append(apart > one + two - 2 * need)
        assert sum(out) >= 99 if all_out else not any(out)
    assert [len(x) for x in linejoin.wide_bitmaps(pool[:40], np.array([0, 40]))] == [0, 1]


def test_line_keys_are_squeezed_and_come_back():
    """With wide bitmaps as byte strings behind the squeezed columns, in order of slots or not."""
    rnd = np.random.default_rng(8)
    n = 500
    for slot in (np.sort(rnd.integers(0, 5, n)), rnd.integers(0, 5, n)):
        cols = {k: rnd.integers(0, 200, n).astype(d) for k, d in linejoin.KEYS.dtypes.items() if k != "_size"}
        sizes = rnd.integers(0, 3, n) * 16
        data = rnd.integers(0, 256, sizes.sum()).astype(np.uint8)
        back = linejoin.KEYS.unpack(linejoin.KEYS.pack(slot, cols | {"wide": (data, sizes)}))
        order, at = np.argsort(slot, kind="stable"), np.cumsum(sizes) - sizes
        assert all((back[k] == cols[k][order]).all() for k in cols)
        assert (back["wide"][1] == sizes[order]).all()
        assert (back["wide"][0] == np.concatenate([data[at[i]:at[i] + sizes[i]] for i in order])).all()


def test_similar_lines_of_all_widths(spark):
    """Lines of 20 to 900 words beside like and unlike ones of other widths."""
    rnd = random.Random(23)
    docs = []
    for d, size in enumerate([20, 60, 96, 111, 114, 150, 177, 200, 330, 399, 402, 460, 900] * 2):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(size)]
        for k, share in enumerate((0, 0.05, 0.1, 0.12, 0.3)):
            cut = base[int(share * size):] if k % 2 else [w if rnd.random() > share else f"x{rnd.randint(0, 10**6)}" for w in base]
            docs.append((10 * d + k, " ".join(rnd.sample(cut, len(cut)))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, digest5(linejoin.similar_lines(df)).collect()))
    assert got == sorted(brute.similar_lines(docs)) and 20 < sum(r[2] for r in got) < 120


def test_forest_region_of_unlinked_members_gives_no_pairs(spark):
    """Alike, but not enough: no region gives out its pairs; of linked ones it gives a link less than members."""
    rnd = np.random.default_rng(11)
    base = rnd.integers(0, 1 << 40, 100).astype(np.uint64)
    sig = np.tile(np.arange(forest.HASHES, dtype=np.uint16), (60, 1))
    doc, side = np.arange(60), np.zeros(60, np.int32)
    half = [np.unique(np.r_[base, rnd.integers(0, 1 << 40, 15).astype(np.uint64)]) for _ in doc]      # 100 of 130 in common
    assert forest.join_region(0, doc, doc, side, sig, half, 85, 88) == []
    close_ = [np.unique(np.r_[base, rnd.integers(0, 1 << 40, 3).astype(np.uint64)]) for _ in doc]
    found = forest.join_region(0, doc, doc, side, sig, close_, 85, 88)
    assert len(found) == 59
    assert forest.join_region(1, doc, doc, side, sig, close_, 85, 88) == []                         # met in tree 0
    assert len(forest.join_region(0, doc, doc % 2, side, sig, close_, 85, 88)) == 1
    across = forest.join_region(0, doc, doc, doc % 2 + 1, sig, close_, 85, 88)
    assert len(across) == 59 and all((a + b) % 2 for a, b in across)


def test_near_groups_of_a_dense_group(spark):
    """Variants of one text about the threshold: many pairs that are no links, components as by brute force."""
    rnd = random.Random(19)
    base = [f"v{rnd.randint(0, 900)}" for _ in range(120)]
    docs = []
    for d in range(150):
        w = list(base)
        for k in rnd.sample(range(120), rnd.randint(1, 3)):
            w[k] = f"n{rnd.randint(0, 10**6)}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(forest.near_duplicates(df, 85)) == sorted(brute.near_groups(docs))

"""Operator 5: line dedup by an exact set-similarity join.

A line is its set of distinct lower-case words. A line goes if an earlier line (smaller
id, or same document and earlier line) has a Jaccard similarity of ``percent`` or more;
lines are judged on the input. Lines of fewer than ``MIN_WORDS`` distinct words stay.

Equal sets form a class, settled per block of documents before the shuffle. Each class's
words are ordered by rarity and its prefix is indexed: similar sets share a word of their
prefixes. Short lines, whose prefixes can be frequent words, are indexed by the first two
common words instead, so no key gathers them. Length, position and bitmap filters choose
candidates; long lines carry wider bitmaps, as many words fill a narrow one whether alike or
not. Jaccard is verified on full sets and the later class is removed.

One similar earlier line is enough, so no group emits all its pairs: every key proposes one
earlier line for each of its lines, the best of all proposals is verified, and only lines it
does not settle go back to their keys for every other candidate.

Rarity: words that make up 1/``SHARE`` of all or more (at most ``SHARE`` words, whatever the
input) by their count, all others first, by hash. The order only steers cost.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text
from voxelspark.llm.text import U64

PERCENT = 80
MIN_WORDS = 5
SHARE = 1 << 16
SHORT = 20                      # lines of up to so many words are indexed by two words
LOW = np.frombuffer(text.LOWER, np.uint8)
SETS = exchange.Records(ragged="words", name="u8", doc="i8", line="i4")
WORDS = exchange.Records(squeeze=True, word="u4", n="i8")
KEYS = exchange.Records(ragged="wide", squeeze=True, step="u4", doc="i8", line="i4", home="i4", bits="u8", more="u4", size="u4", pos="u4", two="u1")   # step: of keys
PAIRS = exchange.Records(doc="i8", line="i4", home="i4", doc_a="i8", line_a="i4", home_a="i4", apart="u2", key_slot="i4")
HALVES = exchange.Records(ragged="words", doc="i8", line="i4", doc_a="i8", line_a="i4")
PLACES = exchange.Records(doc="i8", line="i4")
WIDE = ((112, 2), (176, 4), (400, 8))     # lines of more words than that carry so many further words of bits
RESULT = "doc_id long, n_lines long, removed array<int>"


def line_sets(buf: np.ndarray, bounds: np.ndarray):
    """Lines that have words: text, number in the text, and their distinct word hashes (32 bits, sorted) with bounds.

    Two of the words of a compared pair share a hash about once in 10^5 pairs, which matters only at the threshold."""
    start, end, of = text.words(buf, bounds)
    h = text.Hashes(LOW[buf])(start, end) & U64((1 << 32) - 1)
    breaks = np.cumsum(buf == 10)
    at = breaks[start] if len(start) else start          # line breaks before each word in the block
    base = np.r_[0, breaks][bounds[:-1]]
    number = at - base[of]
    new = np.r_[True, (of[1:] != of[:-1]) | (number[1:] != number[:-1])] if len(of) else np.zeros(0, bool)
    both = np.sort((np.cumsum(new) - 1).astype(U64) << U64(32) | h)               # by line and hash
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    first = np.flatnonzero(new)
    size = np.bincount((both >> U64(32)).astype(np.int64), minlength=len(first))
    return of[first], number[first], both & U64((1 << 32) - 1), np.append(0, np.cumsum(size))


def narrow(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets as a ragged column of four bytes a word."""
    return np.frombuffer(h.astype(np.uint32).tobytes(), np.uint8), np.diff(at) * 4


def wide(ragged) -> tuple[np.ndarray, np.ndarray]:
    raw, sizes = ragged
    return np.frombuffer(raw.tobytes(), np.uint32).astype(U64), np.append(0, np.cumsum(sizes // 4))


def firsts(name: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """True for the earliest row of each name (all rows at that place)."""
    order = np.lexsort((line, doc, name))
    n, d, k = name[order], doc[order], line[order]
    head = np.r_[True, n[1:] != n[:-1]] if len(n) else np.zeros(0, bool)
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    out = np.zeros(len(n), bool)
    out[order] = (d == d[at]) & (k == k[at])
    return out


def places(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One 64-bit value for a document and line."""
    return text.mix(text.mix(doc.astype(np.int64).view(U64)) * U64(3) + line.astype(U64))


def bitmaps(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each set, each the parity of the words that fall on it.

    A word that only one of two sets holds changes one bit, so the sets differ by at least as many words as bits,
    and unlike sets of any size differ in about half of all bits."""
    bit = (text.mix(h.copy()) >> U64(40)) * U64(96) >> U64(24)
    parts = (np.where(bit < 64, U64(1) << (bit & U64(63)), U64(0)), np.where(bit < 64, U64(0), U64(1) << (bit & U64(31))))
    bits, more = (np.bitwise_xor.reduceat(p, at[:-1]) if len(h) else p for p in parts)
    return bits, more


def wide_bitmaps(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of each long set, in 64-bit words, and how many of them a set has: about a bit for each word of a line.

    A word's bit is the same remainder for every width, so a wide bitmap folds to a narrow one (``fold``)."""
    size = np.diff(at)
    width = np.zeros(len(size), np.int64)
    for above, words in WIDE:
        width[size > above] = words
    start = np.append(0, np.cumsum(width))
    out = np.zeros(start[-1], U64)
    for t in range(int(width.max()) if len(width) else 0):
        rows = np.flatnonzero(width > t)
        words, bounds = _take(h, at, rows)
        bit = text.mix(words * U64(7)) >> U64(55)
        mine = (bit >> U64(6)) & np.repeat(width[rows] - 1, np.diff(bounds)).astype(U64) == t
        out[start[rows] + t] = np.bitwise_xor.reduceat(np.where(mine, U64(1) << (bit & U64(63)), U64(0)), bounds[:-1])
    return out, width


def fold(bitmap: np.ndarray, start: np.ndarray, width: np.ndarray, to: int) -> np.ndarray:
    """The bitmaps of ``width`` words at ``start``, as ``to`` words each (a row for every word)."""
    out = np.zeros((to, len(start)), U64)
    for w in {w for _, w in WIDE if w >= to}:
        of = np.flatnonzero(width == w)
        out[:, of] = np.bitwise_xor.reduce(bitmap[start[of] + np.arange(w)[:, None]].reshape(w // to, to, len(of)), axis=0)
    return out


def _take(h, at, rows):
    """The given sets of a ragged column."""
    size = (at[1:] - at[:-1])[rows]
    return h[np.repeat(at[rows], size) + text.spread(size)], np.append(0, np.cumsum(size))


def similar_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, removed``: numbers (from 0) of the lines that an earlier line makes redundant.

    Null texts have one empty line. A null id is an id smaller than all others. Of rows that share an id one
    keeps its place and the others come after all other documents (``exchange.unique_ids``), so each row loses
    only its own lines. Lines and texts of any length are read whole. An empty table gives no rows; other columns
    are ignored."""
    n = exchange.slots_for(docs, text_col)
    docs = exchange.unique_ids(docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")), "own", "text", "doc_id")
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    long = -(-percent * (SHORT + 1) // 100)              # what a line of more than SHORT words can be similar to

    def cut(batches):
        for block in text.blocks(batches):
            ids = block.column("doc_id").to_numpy()
            of, number, h, at = line_sets(*text.utf8(block.column("text")))
            enough = np.diff(at) >= min_words
            h, at = _take(h, at, np.flatnonzero(enough))
            doc, number = ids[of[enough]], number[enough]
            if not len(doc):
                continue
            name = np.add.reduceat(text.mix(h.copy()), at[:-1]) ^ text.mix(np.diff(at).astype(U64))
            own = firsts(name, doc, number)
            size = np.where(own, np.diff(at), 0)         # later lines of a set are known to go: no words
            h = h[np.repeat(own, np.diff(at))]
            cols = {"name": name, "doc": doc, "line": number, "words": narrow(h, np.append(0, np.cumsum(size)))}
            yield SETS.pack((name % U64(n)).astype(np.int64), cols)

    def classes(table):
        """Rows of a slot, the first row of each class, and its words."""
        s = SETS.unpack(table)
        h, at = wide(s["words"])
        has = np.diff(at) > 0
        first = np.zeros(len(has), bool)
        first[has] = firsts(s["name"][has], s["doc"][has], s["line"][has])
        rows = np.flatnonzero(first)
        _, once = np.unique(s["name"][rows], return_index=True)
        return s, first, rows[once], h, at

    def count(table):
        """Frequent words to the slots of words; to each of these, below zero, the number of all."""
        _, _, rows, h, at = classes(table)
        words, c = np.unique(_take(h, at, rows)[0], return_counts=True)
        total = c.sum()
        often = c * (4 * SHARE) >= total                 # what is frequent overall is frequent in a slot
        words, c = np.append(words[often], np.zeros(n, U64)), np.append(c[often], np.full(n, -total))
        slot = np.append((words[:-n] % U64(n)).astype(np.int64), np.arange(n))
        return pa.Table.from_batches([WORDS.pack(slot, {"word": words, "n": c})])

    def frequent(table):
        """The words of a slot that make up 1/SHARE of all or more, in one row."""
        w = WORDS.unpack(table)
        total = -w["n"][w["n"] < 0].sum()
        words, of = np.unique(w["word"], return_inverse=True)
        c = np.bincount(of, np.maximum(w["n"], 0), len(words)).astype(np.int64)
        often = (c > 0) & (c * SHARE >= total)
        return pa.Table.from_batches([WORDS.pack(np.zeros(often.sum(), np.int64), {"word": words[often], "n": c[often]})])

    def index(key, left, right):
        s, _, rows, h, at = classes(left)
        doc, place = s["doc"][rows], s["line"][rows]
        h, at = _take(h, at, rows)
        known = WORDS.unpack(pa.table([right.column("ns").combine_chunks().flatten(), right.column("datas").combine_chunks().flatten()], ["n", "data"]))
        known, counts = known["word"].astype(U64), known["n"].astype(np.int64)
        size = np.diff(at)
        line = np.repeat(np.arange(len(size), dtype=U64) << U64(33), size)
        if len(known):                                   # words from 2^32 on stand for frequent ones, in order of count
            ordered = known[np.lexsort((known, counts))]
            place_of = np.argsort(ordered)
            names = ordered[place_of]
            p = np.minimum(np.searchsorted(names, h), len(names) - 1)
            h = np.where(names[p] == h, U64(1 << 32) + place_of.astype(U64)[p], h)
        h = np.sort(line | h) & U64((1 << 33) - 1)       # by line, count and hash
        if len(known):
            often = np.flatnonzero(h >> U64(32))
            h[often] = ordered[(h[often] & U64((1 << 32) - 1)).astype(np.int64)]
        bits, more = bitmaps(h, at)
        wide_bits, width = wide_bitmaps(h, at)
        wide_at = np.append(0, np.cumsum(width))
        prefix = size - -(-percent * size // 100) + 1
        out = []
        one = np.flatnonzero(size >= long)
        row, pos = np.repeat(one, prefix[one]), text.spread(prefix[one])
        out.append((h[at[row] + pos], row, pos, np.zeros(len(row), np.uint8)))
        two = np.flatnonzero(size <= SHORT)
        m = np.minimum(prefix[two] + 1, size[two])
        for far in range(1, int(m.max()) if len(m) else 0):
            some = two[m > far]
            row, i = np.repeat(some, far), text.spread(np.full(len(some), far))
            word = text.mix(h[at[row] + i] * U64(3) + text.mix(h[at[row] + far]))
            out.append((word, row, np.full(len(row), far), np.ones(len(row), np.uint8)))
        word, row, pos, two = (np.concatenate(c) for c in zip(*out, strict=True))
        word = text.mix(word + two.astype(U64))
        slot, word = (word % U64(n)).astype(np.int64), (word >> U64(32)).astype(np.uint32)
        order = np.argsort(slot.astype(U64) << U64(32) | word)
        slot, word, row, pos, two = (c[order] for c in (slot, word, row, pos, two))
        step = np.diff(word, prepend=np.uint32(0))       # rising within a slot: small steps
        begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])[:len(slot)]
        step[begin] = word[begin]
        sketch, _ = _take(wide_bits, wide_at, row)
        cols = {"step": step, "doc": doc[row], "line": place[row], "home": np.full(len(row), key[0].as_py()), "bits": bits[row], "more": more[row],
                "size": size[row], "pos": pos, "two": two, "wide": (sketch.view(np.uint8), 8 * width[row])}
        return pa.Table.from_batches([KEYS.pack(slot, cols)])

    def keys_of(table) -> tuple[dict, np.ndarray]:
        """Unpacked rows of a slot with their keys; steps begin anew in each home's row."""
        k = KEYS.unpack(table)
        new = np.flatnonzero(np.r_[True, k["home"][1:] != k["home"][:-1]])[:len(k["home"])]
        key = np.cumsum(k["step"], dtype=U64)
        key -= np.repeat(np.r_[U64(0), key][new], np.diff(np.r_[new, len(key)]))
        sketch, sizes = k.pop("wide")
        return k | {"key": key.astype(np.uint32), "start": (np.cumsum(sizes) - sizes) // 8, "width": sizes // 8}, sketch.view(U64)

    def pairs_of(k: dict, wide_bits: np.ndarray, asked: np.ndarray | None):
        """Earlier candidates of a slot's lines: the one least apart for each key and line, or all of the lines asked for."""
        order = np.argsort(k["key"].astype(U64) << U64(32) | k["size"])
        k = {c: v[order] for c, v in k.items() if c != "step"}
        asked = asked[order] if asked is not None else None
        key, doc, line, bits, more, two = (k[c] for c in ("key", "doc", "line", "bits", "more", "two"))
        size = k["size"].astype(np.int64)
        rest, have = size - k["pos"] - 1, two.astype(np.int64) + 1
        best, mate = np.full(len(key), 1 << 30, np.int32), np.full(len(key), -1, np.int64)
        later_, earlier_ = [], []
        i, far = np.arange(max(0, len(key) - 1)), 1
        while len(i):
            j = i + far
            near = (key[i] == key[j]) & (100 * size[i] >= percent * size[j])      # sizes rise within a key
            i, j = i[near], j[near]
            one = i
            if asked is not None:
                want = asked[i] | asked[j]
                one, j = i[want], j[want]
            both = size[one] + size[j]
            most = both - 2 * -(-percent * both // (100 + percent))               # words that only one may have
            apart = np.bitwise_count(bits[one] ^ bits[j]) + np.bitwise_count(more[one] ^ more[j])
            ok = apart <= most
            one, j, both, most, apart = one[ok], j[ok], both[ok], most[ok], apart[ok].astype(np.int32)
            ok = (have[one] + np.minimum(rest[one], rest[j]) >= (both - most) // 2) & (two[one] == two[j])
            ok &= (doc[one] != doc[j]) | (line[one] != line[j])
            width = np.minimum(k["width"][one], k["width"][j])
            for w in set(width[ok].tolist()) - {0}:
                of = np.flatnonzero(ok & (width == w))
                x, y = (fold(wide_bits, k["start"][r[of]], k["width"][r[of]], w) for r in (one, j))
                wide_apart = np.bitwise_count(x ^ y).sum(axis=0, dtype=np.int32)
                apart[of] = np.maximum(apart[of], wide_apart)
                ok[of] = wide_apart <= most[of]
            one, j, apart = one[ok], j[ok], apart[ok]
            before = (doc[one] < doc[j]) | (doc[one] == doc[j]) & (line[one] < line[j])
            for pick, later, earlier in ((before, j, one), (~before, one, j)):
                later, earlier, d = later[pick], earlier[pick], apart[pick]
                if asked is not None:
                    want = asked[later]
                    later_.append(later[want])
                    earlier_.append(earlier[want])
                    continue
                less = d < best[later]
                best[later[less]], mate[later[less]] = d[less], earlier[less]
            far += 1
            i = i[i + far < len(key)]
        if asked is None:
            later = np.flatnonzero(mate >= 0)
            later = later[np.lexsort((best[later], line[later], doc[later]))]     # of a slot's keys, the best for each line
            new = np.r_[True, (doc[later][1:] != doc[later][:-1]) | (line[later][1:] != line[later][:-1])] if len(later) else np.zeros(0, bool)
            later = later[new]
            earlier, apart = mate[later], np.minimum(best[later], 65535)
        else:
            later, earlier = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (later_, earlier_))
            both = text.mix(places(doc[later], line[later]) * U64(5) + places(doc[earlier], line[earlier]))
            _, once = np.unique(both, return_index=True)
            later, earlier = later[once], earlier[once]
            apart = np.zeros(len(later), np.uint16)
        return {"doc": doc[later], "line": line[later], "home": k["home"][later], "doc_a": doc[earlier], "line_a": line[earlier],
                "home_a": k["home"][earlier], "apart": apart}

    def propose(key, table):
        out = pairs_of(*keys_of(table), None)
        out["key_slot"] = np.full(len(out["doc"]), key[0].as_py())
        return pa.Table.from_batches([PAIRS.pack(out["home"].astype(np.int64), out)])

    def choose(table):
        """The best proposal for each line goes to the slot of the earlier line."""
        p = PAIRS.unpack(table)
        order = np.lexsort((p["line_a"], p["doc_a"], p["apart"], p["line"], p["doc"]))
        p = {c: v[order] for c, v in p.items()}
        new = np.r_[True, (p["doc"][1:] != p["doc"][:-1]) | (p["line"][1:] != p["line"][:-1])] if len(order) else np.zeros(0, bool)
        p = {c: v[new] for c, v in p.items()}
        return pa.Table.from_batches([PAIRS.pack(p["home_a"].astype(np.int64), p)])

    def rows_at(s, rows, doc, line):
        """Rows of the classes at the given places."""
        have = places(s["doc"][rows], s["line"][rows])
        order = np.argsort(have)
        return rows[order[np.searchsorted(have[order], places(doc, line))]]

    def attach(left, right):
        """The words of the earlier line go to the slots of its later ones, once to each slot."""
        s, _, rows, h, at = classes(left)
        p = PAIRS.unpack(right)
        if not len(p["doc"]):
            return pa.Table.from_batches([HALVES.empty()])
        row = rows_at(s, rows, p["doc_a"], p["line_a"])
        order = np.lexsort((row, p["home"]))
        p, row = {c: v[order] for c, v in p.items()}, row[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (p["home"][1:] != p["home"][:-1])]
        words, bounds = _take(h, at, row[new])
        data, sizes = narrow(words, bounds)
        size = np.zeros(len(row), np.int64)
        size[new] = sizes                                # the others of a slot refer to it by place
        cols = {c: p[c] for c in ("doc", "line", "doc_a", "line_a")} | {"words": (data, size)}
        return pa.Table.from_batches([HALVES.pack(p["home"].astype(np.int64), cols)])

    def verify(first_round: bool):
        def run(key, left, right):
            """Removed places go to their documents; in the first round, lines not settled are named (slots from ``n`` on)."""
            s, first, rows, h, at = classes(left)
            p = HALVES.unpack(right)
            theirs, bounds = wide(p["words"])
            ok = np.zeros(len(p["doc"]), bool)
            if len(ok):
                at_row = rows_at(s, rows, p["doc"], p["line"])
                name, with_words = places(p["doc_a"], p["line_a"]), np.flatnonzero(np.diff(bounds) > 0)
                with_words = with_words[np.argsort(name[with_words], kind="stable")]
                of = with_words[np.searchsorted(name[with_words], name)]
                for i, (r, o) in enumerate(zip(at_row.tolist(), of.tolist(), strict=True)):
                    x, y = h[at[r]:at[r + 1]], theirs[bounds[o]:bounds[o + 1]]
                    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            doc, line = p["doc"][ok], p["line"][ok]
            if first_round:                              # with the later lines of every class
                doc, line = np.r_[s["doc"][~first], doc], np.r_[s["line"][~first], line]
            out = [PLACES.pack(exchange.id_slot(doc.astype(np.int64), n), {"doc": doc, "line": line})]
            if first_round:
                out.append(PLACES.pack(np.full((~ok).sum(), n + key[0].as_py()), {"doc": p["doc"][~ok], "line": p["line"][~ok]}))
            return pa.Table.from_batches(out)
        return run

    def ask_again(left, right):
        """Lines not settled go back to the slots whose keys proposed something."""
        p, u = PAIRS.unpack(left), PLACES.unpack(right)
        open_ = np.isin(places(p["doc"], p["line"]), places(u["doc"], u["line"]))
        cols = {"doc": p["doc"][open_], "line": p["line"][open_]}
        return pa.Table.from_batches([PLACES.pack(p["key_slot"][open_].astype(np.int64), cols)])

    def all_candidates(left, right):
        u = PLACES.unpack(right)
        if not len(u["doc"]):
            return pa.Table.from_batches([PAIRS.empty()])
        k, wide_bits = keys_of(left)
        asked = np.isin(places(k["doc"], k["line"]), places(u["doc"], u["line"]))
        group = np.isin(k["key"], k["key"][asked])
        out = pairs_of({c: v[group] for c, v in k.items()}, wide_bits, asked[group])
        out["key_slot"] = np.zeros(len(out["doc"]), np.int32)
        return pa.Table.from_batches([PAIRS.pack(out["home_a"].astype(np.int64), out)])

    def gather(left, right):
        g = PLACES.unpack(right)
        place = np.unique(np.stack([g["doc"], g["line"].astype(np.int64)], 1), axis=0) if len(g["doc"]) else np.zeros((0, 2), np.int64)
        ids = left.column("doc_id").to_numpy()
        lo, hi = np.searchsorted(place[:, 0], ids, "left"), np.searchsorted(place[:, 0], ids, "right")
        size = hi - lo
        line = place[np.repeat(lo, size) + text.spread(size), 1]
        bounds = np.append(0, np.cumsum(size))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(line, pa.int32()))
        return pa.table([left.column("own"), left.column("n_lines"), lists], ["doc_id", "n_lines", "removed"])

    sets = docs.select("doc_id", "text").mapInArrow(cut, exchange.PACKED)
    by_class = sets.groupBy("slot")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot")
    often = by_class.applyInArrow(count, exchange.PACKED).groupBy("slot").applyInArrow(frequent, exchange.PACKED)
    table = often.agg(F.collect_list("n").alias("ns"), F.collect_list("data").alias("datas")).select(every, "ns", "datas")   # SHARE words at most
    keys = by_class.cogroup(table.groupBy("slot")).applyInArrow(index, exchange.PACKED).groupBy("slot")
    proposed = keys.applyInArrow(propose, exchange.PACKED).groupBy("slot")
    halves = by_class.cogroup(proposed.applyInArrow(choose, exchange.PACKED).groupBy("slot")).applyInArrow(attach, exchange.PACKED)
    first = by_class.cogroup(halves.groupBy("slot")).applyInArrow(verify(True), exchange.PACKED)
    unsettled = first.filter(F.col("slot") >= n).withColumn("slot", F.col("slot") - n)
    asked = proposed.cogroup(unsettled.groupBy("slot")).applyInArrow(ask_again, exchange.PACKED)
    rest = keys.cogroup(asked.groupBy("slot")).applyInArrow(all_candidates, exchange.PACKED)
    halves = by_class.cogroup(rest.groupBy("slot")).applyInArrow(attach, exchange.PACKED)
    gone = by_class.cogroup(halves.groupBy("slot")).applyInArrow(verify(False), exchange.PACKED)
    gone = first.filter(F.col("slot") < n).unionByName(gone)
    lines = docs.select("doc_id", F.col("own").cast("long").alias("own"), (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                        exchange.id_slot(F.col("doc_id"), n).alias("slot"))
    return lines.groupBy("slot").cogroup(gone.groupBy("slot")).applyInArrow(gather, RESULT)


def op5_similar_lines(spark, sf_dir):
    return similar_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))

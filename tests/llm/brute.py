"""Plain single-process versions of the operators, for small tables."""
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spans_of(flags):
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def repeated_bytes(docs, length=100):
    """docs: list of (doc_id, text), unique ids."""
    first, out = {}, []
    texts = sorted((d, (t or "").encode()) for d, t in docs)
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            s = t[i:i + length]
            if s in first:
                gone[i:i + length] = b"\1" * length
            else:
                first[s] = 1
        out.append((d, len(t), sum(gone), spans_of(gone), sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def repeated_words(docs, length=13):
    first, all_words = {}, {d: words(t) for d, t in docs}
    for d in sorted(all_words):
        w = all_words[d]
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i:i + length]), d)
    out = []
    for d in sorted(all_words):
        w = all_words[d]
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < d:
                gone[i:i + length] = [True] * length
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def benchmark_hits(docs, items, window=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    pats = {}
    for item, t in items:
        if item is None:
            continue
        w = split.findall(lower(t or ""))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            pats.setdefault(tuple(w[i:i + window]), set()).add(str(item))
    sizes = {len(p) for p in pats}
    out = []
    for d, t in docs:
        w = split.findall(lower(t or ""))
        hit, met = [False] * len(w), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i:i + m])) in pats:
                    hit[i:i + m] = [True] * m
                    met |= pats[p]
        out.append((d, len(w), sum(hit), len(met), sha(",".join(sorted(met)).encode()), any(hit)))
    return out


def quality(docs, min_docs=20):
    """docs: (doc_id, text, host)."""
    base, lines = [], {}
    for d, t, host in docs:
        t, host = t or "", host or ""
        w = words(t)
        repeat = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        gone = [False] * len(w)
        for i in range(len(w) - 4):
            if repeat[tuple(w[i:i + 5])] > 1:
                gone[i:i + 5] = [True] * 5
        own = [x for x in t.split("\n") if words(x)]
        content = " ".join(words(lower(t)))
        norm = [" ".join(words(lower(x))) for x in own]
        for x in set(norm):
            lines.setdefault((host, x), set()).add(content)
        base.append((d, host, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), sum(gone), norm))
    out = []
    for d, host, n, chars, symbols, dup, rep, norm in base:
        lost = sum(len(x.split(" ")) for x in norm
                   if len(lines[host, x]) >= min_docs)
        failed = n < 10 or 100 * rep > 20 * n
        out.append((d, n, chars, symbols, dup, rep, failed, not failed and n - lost >= 10 and n - lost >= 0.25 * n))
    return out


def token_files(docs, end=1):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = [], 0
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def near_groups(docs, percent=85, size=5):
    sets = {}
    for d, t in docs:
        w = words(lower(t or ""))
        sets[d] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1:]}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [(d, len(sets[d]), root(d), root(d) == d) for d in sets]


def similar_lines(docs, percent=80, min_words=5):
    rows = []
    for d, t in sorted(docs):
        for k, x in enumerate((t or "").split("\n")):
            s = frozenset(words(lower(x)))
            if len(s) >= min_words:
                rows.append((d, k, s))
    by, gone = {}, {}
    for i, (d, k, s) in enumerate(rows):
        common = Counter(j for w in s for j in by.get(w, ()))
        if any(100 * c >= percent * (len(s) + len(rows[j][2]) - c) for j, c in common.items()):
            gone.setdefault(d, []).append(k)
        for w in s:
            by.setdefault(w, []).append(i)
    return [(d, len((t or "").split("\n")), len(gone.get(d, ())), ",".join(map(str, gone.get(d, ())))) for d, t in docs]


def katz(docs, min_pair=2, k=5):
    """Scores, and the model as functions, from plain dictionaries."""
    import math
    import zlib

    def discounts(counts):
        n = Counter(counts.values())
        out = {}
        if n[1] and (common := (k + 1) * n[k + 1] / n[1]) < 1:
            for r in range(1, k + 1):
                if n[r] and 0 < (d := ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)) <= 1:
                    out[r] = d
        return out
    toks = {i: [*words(lower(t or "")), None] for i, (d, t) in enumerate(docs)}
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    uni, pair, ctx = Counter(), Counter(), Counter()
    for i, ts in toks.items():
        if not held[i]:
            uni.update(ts)
            pair.update(zip(["<s>", *ts], ts))
            ctx.update(["<s>", *ts[:-1]])
    n, v = sum(uni.values()), len(uni)
    du, dp = discounts(uni), discounts(pair)
    left = n - sum(du.get(c, 1) * c for c in uni.values())
    total, unknown = (n, left / n) if left > 1e-9 * n else (n + 1, 1 / (n + 1))

    def p1(w):
        return du.get(uni[w], 1) * uni[w] / total if uni[w] else unknown
    taken, low = Counter(), Counter()
    for (u, w), c in pair.items():
        if c >= min_pair:
            taken[u] += dp.get(c, 1) * c
            low[u] += p1(w)

    def p2(w, u):
        c = ctx[u]
        bump = c > 0 and c - taken[u] <= 1e-9 * c
        if pair[u, w] >= min_pair:
            return dp.get(pair[u, w], 1) * pair[u, w] / (c + bump)
        if not c:
            return p1(w)
        return (1 / (c + 1) if bump else (c - taken[u]) / c) / (1 - low[u]) * p1(w)
    out = []
    for i, (d, _) in enumerate(docs):
        ts = toks[i]
        out.append((d, held[i], len(ts), sum(uni[w] > 0 for w in ts), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ts),
                    sum(math.log10(p2(w, u)) for u, w in zip(["<s>", *ts], ts))))
    return out, (p2, uni, ctx)

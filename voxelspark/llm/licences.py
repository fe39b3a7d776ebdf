"""Operator 7: licence scan by conditional compression.

Blocks around licence words are compressed alone and with each template as a raw
zstandard dictionary. Templates are ranked by how much they shorten the block; the
winners are confirmed by exact wording: the words of the template must stand in the
block with at most ``DIFFER`` of them changed, and the differences are reported. No
difference may touch a word that tells licences apart (``NAMES``, or one with a digit).
"""
from __future__ import annotations

import difflib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import exchange, text

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} "
        "License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:")
_BSD2 = (_BSD + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
         "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
         "following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD3 = (_BSD2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
         "products derived from this software without specific prior written permission.")
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."

# Public licence notices by SPDX name. The opening of the BSD licences alone does not tell which one it is.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD", _BSD),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", _BSD2.replace(" 1.", "").replace(" 2.", "")),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", _BSD3.replace(" 1.", "").replace(" 2.", "").replace(" 3.", "")),
    ("CC0-1.0", "This work is licensed under a Creative Commons Zero v1.0 Universal License."),
    ("CC0-1.0", "This work is licensed under the CC0 1.0 Universal Public Domain Dedication."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", _CC.format("Attribution-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-ND-4.0", _CC.format("Attribution-NonCommercial-NoDerivs")),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", _CC.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", _CC.format("Attribution-NoDerivatives")),
    ("CC-BY-ND-4.0", _CC.format("Attribution-NoDerivs")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("General Public", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format("Lesser General Public", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
CUE = r"licen[cs]e|copyright|permission (?:is hereby granted|to use)|redistribution and use"
#: Parts of words that name a licence or one of its terms.
NAMES = frozenset("affero apache attribution bsd by cc cc0 commons creative gnu gpl agpl lgpl isc lesser library mit mozilla mpl nc nd sa "
                  "noncommercial noderivs noderivatives sharealike zero dedication domain fee sell neither endorse promote".split())
DIFFER = 0.1                    # share of a template's words that may differ
MARGIN = 8                      # words of a block beyond the longest template, on either side of its cues
LEVEL = 3
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
FOUND = ("doc_id long, n_blocks long, found array<struct<licence:string,start:int,end:int,saved:int,exact:boolean,differences:array<string>>>")
_ROWS = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.int32()),
                            ("exact", pa.bool_()), ("differences", pa.list_(pa.string()))]))


def words_of(s: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(s)]


def naming(word: str) -> bool:
    return any(c.isdigit() for c in word) or not NAMES.isdisjoint(re.split(r"[.\-]", word))


class Templates:
    """Templates with a compressor each."""

    def __init__(self, templates):
        import zstandard
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.each = []
        for name, wording in templates:
            raw = zstandard.ZstdCompressionDict(wording.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = [w for w, _, _ in words_of(wording)]
            self.each.append((name, own, Counter(own), {w for w in own if naming(w)}, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)))
        self.longest = max((len(w) for _, w, *_ in self.each), default=0)

    def ranked(self, block: str, words: list[str], differ: float):
        """Bytes saved by each template that the words of the block allow, most first."""
        have = Counter(words)
        able = [(name, w, c) for name, w, count, names, c in self.each
                if names <= have.keys() and sum(min(k, have[x]) for x, k in count.items()) >= (1 - differ) * len(w)]
        if not able:
            return []
        raw = block.lower().encode()
        alone = len(self.plain.compress(raw))
        saved = [(alone - len(c.compress(raw)), len(w), name, w) for name, w, c in able]
        return sorted((s for s in saved if s[0] > 0), key=lambda s: (-s[0], -s[1], s[2]))


def differences(template: list[str], block: list[str], differ: float):
    """First and last block word the template stands on, and what differs; None if too much does, or a word that names."""
    m = difflib.SequenceMatcher(None, block, template, autojunk=False)
    same = [b for b in m.get_matching_blocks() if b.size]
    if sum(b.size for b in same) < (1 - differ) * len(template):
        return None
    lo, hi = same[0].a, same[-1].a + same[-1].size
    ops = difflib.SequenceMatcher(None, template, block[lo:hi], autojunk=False).get_opcodes()
    apart = [(t, template[a:b], block[lo + c:lo + d]) for t, a, b, c, d in ops if t != "equal"]
    if sum(max(len(x), len(y)) for _, x, y in apart) > differ * len(template) or any(naming(w) for _, x, y in apart for w in (*x, *y)):
        return None
    return lo, hi, [f"{t}: {' '.join(x)} -> {' '.join(y)}" for t, x, y in apart]


def blocks_of(s: str, cue: re.Pattern, margin: int):
    """Words around each run of cues that are at most ``margin`` words apart."""
    hits = [m.start() for m in cue.finditer(s)]
    if not hits:
        return
    words = words_of(s)
    starts = [w[1] for w in words]
    import bisect
    at = [max(0, bisect.bisect_right(starts, h) - 1) for h in hits]
    lo = hi = at[0]
    for k in [*at[1:], None]:
        if k is None or k - hi > margin:
            yield words[max(0, lo - margin):hi + margin + 1]
            lo = k
        hi = k


def scan_text(s: str, templates: Templates, cue: re.Pattern, differ: float):
    """Number of candidate blocks and the licences confirmed in a text."""
    found, n = [], 0
    for block in blocks_of(s, cue, templates.longest + MARGIN):
        n += 1
        own = [w for w, _, _ in block]
        taken: list[tuple[int, int]] = []
        for saved, _, name, wording in templates.ranked(s[block[0][1]:block[-1][2]], own, differ):
            at = 0
            while (d := differences(wording, own[at:], differ)) is not None:
                lo, hi, apart = d[0] + at, d[1] + at, d[2]
                if not any(lo < b and a < hi for a, b in taken):     # a better template stands there
                    taken.append((lo, hi))
                    found.append({"licence": name, "start": block[lo][1], "end": block[hi - 1][2], "saved": saved,
                                  "exact": not apart, "differences": apart})
                at = hi
    return n, sorted(found, key=lambda f: (f["start"], f["licence"]))


def licences(docs: DataFrame, templates=TEMPLATES, cue: str = CUE, differ: float = DIFFER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_blocks, found``: candidate blocks, and each confirmed licence with its place (characters),
    bytes saved and wording differences.

    Null and empty texts have no blocks; a null id stays null. Rows are scanned one by one, repeated ones
    too. Other columns are ignored. Only texts with a cue reach Python."""
    docs = exchange.documents(docs, id_col, text_col).select(
        exchange.restore_id(), F.when(F.lower("text").rlike(cue), F.col("text")).otherwise("").alias("text"))

    def run(batches):
        held, pattern = Templates(templates), re.compile(cue, re.I)
        for block in text.blocks(batches):
            rows = [scan_text(s, held, pattern, differ) if s else (0, []) for s in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([f for _, f in rows], _ROWS)],
                                             ["doc_id", "n_blocks", "found"])
    return docs.mapInArrow(run, FOUND)


def op7_licence_scan(spark, sf_dir):
    """``exact``: every notice found stands word by word; ``differences``: those of each notice, by place."""
    found = licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["licence"])))
    apart = F.transform(F.filter("found", lambda f: ~f["exact"]), lambda f: F.concat(f["licence"], F.lit(" "), F.array_join(f["differences"], ", ")))
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(names, ",").alias("licences"),
                        F.when(F.size("found") > 0, F.forall("found", lambda f: f["exact"])).alias("exact"),
                        F.array_join(apart, "; ").alias("differences"))

"""Token ids of whole texts, with a bounded cache of white-space separated pieces.

The vocabulary drops white space and never joins pieces across it, so a text's ids
are its pieces' ids in a row. Pieces repeat a lot: those of a block of texts that the
cache lacks are encoded some at a time (long calls cost more a piece) and told apart by their offsets.
"""
from __future__ import annotations

import numpy as np

from voxelspark.llm.text import LOWER, byte_class, utf8

FORM = np.frombuffer(LOWER, np.uint8).copy()
FORM[10] = 32
WORDY = byte_class([*range(97, 123)])
STOP = byte_class(b",.")
CACHE = 400_000                 # pieces of the younger generation in a worker process; the older has as many
LONGEST = 64                    # longer pieces are not kept
CALL = 128                      # pieces encoded in one call


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a vocabulary file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``. ``path``: file of the tokenizers library."""

    def __init__(self, path: str | None = None, dtype: str = "<u4"):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path or vocabulary())
        self.dtype = np.dtype(dtype)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        start = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        n = len(found)
        at = np.fromiter((o[0] for o in found.offsets), np.int64, n)
        ids = np.fromiter(found.ids, self.dtype, n).tobytes()
        cut = (np.r_[0, np.searchsorted(at, start)] * self.dtype.itemsize).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def __call__(self, column) -> list[bytes]:
        """Ids of every text of an Arrow column without nulls."""
        buf, bounds = utf8(column)
        plain, bounds = _plain(buf, bounds)
        whole = plain.tobytes().decode()
        if len(whole) == len(plain):                     # ASCII throughout: bytes are characters
            cuts = bounds.tolist()
        else:
            cuts = np.r_[0, np.cumsum((plain & 0xC0) != 0x80)][bounds].tolist()
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {"": b""}
        pieces, ends = [], [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pieces += whole[a:b].split(" ")
            ends.append(len(pieces))
        ids = list(map(self.young.get, pieces))
        lack = [i for i, found in enumerate(ids) if found is None]
        names = {pieces[i] for i in lack}
        block = {p: self.old[p] for p in names if p in self.old}
        new = [p for p in names if p not in block]
        for at in range(0, len(new), CALL):
            some = new[at:at + CALL]
            block.update(zip(some, self._encode(some), strict=True))
        for i in lack:
            ids[i] = block[pieces[i]]
        self.young.update((p, v) for p, v in block.items() if len(p) <= LONGEST)
        return [b"".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _plain(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in the form the vocabulary reads them in, so that fewer pieces differ: ASCII capitals
    made small, line breaks as spaces, and a space before a comma or stop between a word and a space.
    A text that spells out a special token is left alone but for its line breaks."""
    special = np.zeros(len(bounds) - 1, bool)
    mark = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124)) if len(buf) else np.zeros(0, np.int64)      # <|
    special[np.searchsorted(bounds, mark, "right") - 1] = True
    out = FORM[buf]
    word = WORDY[out]
    stop = np.zeros(len(out), bool)
    stop[1:-1] = STOP[out[1:-1]] & word[:-2] & (out[2:] == 32)
    if special.any():
        own = np.repeat(special, np.diff(bounds))
        out[own] = np.where(buf[own] == 10, 32, buf[own])
        stop &= ~own
    at = np.flatnonzero(stop)
    text = np.searchsorted(bounds, at, "right") - 1
    at = at[(at > bounds[text]) & (at + 1 < bounds[text + 1])]       # its neighbours are of the same text
    return np.insert(out, at, 32), bounds + np.searchsorted(at, bounds)


_encoders: dict = {}


def encoder(path: str | None, dtype: str) -> Encoder:
    """One encoder a worker process."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]

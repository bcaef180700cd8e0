"""Token ids of whole texts, vectorised: byte-level BPE from a public vocabulary file.

A block of texts is cut into the pattern's pre-tokens with numpy; each different
pre-token is encoded once per worker (a bounded cache keeps the frequent ones).
Texts with characters whose pre-token rules need more (apostrophes, anything
past Latin letters, odd white space) go through the tokenizer whole.
"""

from __future__ import annotations

import base64
import unicodedata
from itertools import chain

import numpy as np

from cadenza.llm import kernel

VOCABULARY = "byte_bpe_50k.tiktoken"
END_ID = 0
CACHE_KEYS = 800_000
_LIMIT = 0x250                       # code points above go to the tokenizer itself


def _classes() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 0 other, 9 "let the tokenizer decide"."""
    c = np.zeros(_LIMIT + 1, np.uint8)
    for i in range(_LIMIT):
        kind = unicodedata.category(chr(i))[0]
        c[i] = 1 if kind == "L" else 2 if kind == "N" else 0
    c[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0]] = 3
    c[0x1C:0x20] = 9
    c[ord("'")] = 9
    c[_LIMIT] = 9
    return c


class Tokenizer:
    """``encode(bytes, offsets)`` -> (ids of all texts, ids per text)."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)      # of each key's ids in ``flat``
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        ids = [self.bpe.encode_ordinary(s) for s in strings]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.concatenate(([0], np.cumsum(size)[:-1]))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))))
        place = np.searchsorted(self.keys, keys)                   # ``keys`` is sorted
        self.keys = np.insert(self.keys, place, keys)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, size)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offs) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        offs = heads[offs]                                          # now in code points
        n = len(points)
        kind = self.classes[np.minimum(points, _LIMIT)]
        space = kind == 3
        edge = np.zeros(n + 1, bool)
        edge[offs] = True                                           # a text begins (or the end)
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 255, kind[:-1]
        before[edge[:n]] = 255
        follows = np.zeros(n, bool)                                 # a character of the text follows that isn't white space
        follows[:-1] = ~space[1:] & ~edge[1:n]
        blank = np.zeros(n, bool)                                   # the character before is a plain blank
        blank[1:] = points[:-1] == 0x20
        blank &= before == 3
        starts = np.where(space, (before != 3) | follows, (before != kind) & ~blank)
        start = np.flatnonzero(starts)
        end = np.append(start[1:], n)
        doc = np.searchsorted(offs, start, "right") - 1
        odd = np.zeros(n_docs, bool)
        odd_at = np.flatnonzero(kind == 9)
        odd[np.searchsorted(offs, odd_at, "right") - 1] = True
        usual = ~odd[doc]
        start, end, doc = start[usual], end[usual], doc[usual]
        keys, first, which = np.unique(kernel.span_hash(points, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_KEYS:
            self._forget()
        pos = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = pos < len(self.keys)
        new[inside] = self.keys[pos[inside]] != keys[inside]
        if new.any():
            w = first[new]
            self._learn(keys[new], [text[a:b] for a, b in zip(start[w].tolist(), end[w].tolist(), strict=True)])
            pos = np.searchsorted(self.keys, keys)
        size, at = self.size[pos][which], self.at[pos][which]
        counts = np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64)
        total = int(size.sum())
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        ids = self.flat[np.repeat(at, size) + within]
        if not odd.any():
            return ids, counts
        cut = np.concatenate(([0], np.cumsum(counts)))
        parts = []
        for d in range(n_docs):
            if odd[d]:
                own = np.array(self.bpe.encode_ordinary(text[offs[d]:offs[d + 1]]), np.uint32)
                counts[d] = len(own)
                parts.append(own)
            else:
                parts.append(ids[cut[d]:cut[d + 1]])
        return np.concatenate(parts), counts


_TOKENIZERS: dict[str | None, Tokenizer] = {}


def tokenizer(path: str | None = None) -> Tokenizer:
    """One per Python worker and vocabulary file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def documents_of(batch, path: str | None = None):
    """(row, ids with the end id) for every text of an Arrow batch."""
    t = tokenizer(path)
    for lo, hi, data, offs in kernel.blocks(batch.column("text")):
        ids, counts = t.encode(data, offs)
        cut = np.concatenate(([0], np.cumsum(counts)))
        end = np.array([END_ID], np.uint32)
        for d in range(hi - lo):
            yield lo + d, np.concatenate((ids[cut[d]:cut[d + 1]], end))


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` tokens; only longer ones are cut,
    and only the first piece of those may be shorter than ``capacity``."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]

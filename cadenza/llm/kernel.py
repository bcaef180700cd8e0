"""Vectorised text kernels for Arrow tasks: word spans, word and gram hashes.

Everything works on the bytes of an Arrow string column, a block of documents
at a time, so no Python object is made per word. Hashes are 64-bit: two
different words or grams agree with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below ``n``."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; NULL reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def blocks(col, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    data, offs = column_bytes(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block_bytes, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, is_space: np.ndarray = _IS_SPACE):
    """(start, end, document) of every maximal run of bytes that aren't separators."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~is_space[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    begins = offs[:-1]
    first[begins[begins < n]] = True
    first &= inside
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    ends = offs[1:]
    last[ends[ends > 0] - 1] = True
    last &= inside
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, "right") - 1


def running_hash(values: np.ndarray) -> np.ndarray:
    """What ``span_hash`` sums up of ``values`` (bytes or code points), before each place:
    made once where several sets of spans are hashed."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    own = values.astype(np.uint64)
    own += np.uint64(1)
    own *= _powers(n + 1)[0][:n]
    np.cumsum(own, out=total[1:])
    return total


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span of ``values``; ``total``: their ``running_hash``, if at hand."""
    total = running_hash(values) if total is None else total
    h = (total[end] - total[start]) * _powers(len(total))[1][start]
    return mix(h ^ ((end - start).astype(np.uint64) * _STEP))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (runs may cross documents)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(m, k, np.uint64)
    for j in range(k):
        g = g * _STEP + h[j:j + m]
    return mix(g)


def bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Index of each document's first word; one more for the end."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def grams(h: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``k``-grams of each document and their cuts; a document of fewer
    words (but not none) gives its whole sequence as one gram."""
    n_words = np.diff(cut)
    g = gram_hash(h, k)
    keep = np.zeros(len(h), bool)
    out = np.zeros(len(h), np.uint64)
    out[:len(g)] = g
    doc_of = np.repeat(np.arange(len(n_words)), n_words)
    keep[:] = np.arange(len(h)) + k <= cut[1:][doc_of]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        out[cut[d]] = gram_hash(h[cut[d]:cut[d + 1]], int(n_words[d]))[0]
        keep[cut[d]] = True
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    return out[keep], np.concatenate(([0], np.cumsum(counts)))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)

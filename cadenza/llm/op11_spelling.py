"""Spelling variants by reduced-alphabet generation.

The vocabulary is counted over all texts. A hash puts every letter into one of
``SYMBOLS`` classes, so a word becomes a shorter-alphabet word of the same length,
and one edit of a word is at most one edit of its reduced word. Each different
reduced word generates its full one-edit neighbourhood (itself, deletions,
replacements and insertions over the small alphabet) as rolling hashes; a filter
of fixed size over the reduced vocabulary drops most neighbours that nobody has
before they leave the task, and a join on the hash finds the rest. The original
words of two neighbouring classes are then verified by their edit distance, so
hashes and filter decide nothing. Neighbourhoods are symmetric: a pair of classes
is only emitted by the one with the smaller hash.

A word's form is its near word of largest count, if that is ``RATIO`` times its
own or more; counts at least double along forms, so a chain has at most 63 steps
and six rounds of pointer doubling reach every root.

Before counting, runs are thinned as the query's contract says: if the crc32 of
``<doc_id>:<run>`` is a multiple of ``DELETE_EVERY`` a code point is left out.

Edge cases: NULL, empty or letterless texts give no words. A NULL doc_id reads as
an empty id. Rows that repeat count again. Ties of counts go to the word that is
smaller in code-point order. Very long runs are words as all others; very long
texts are read in pieces cut between runs. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import kernel
from cadenza.llm.common import bit_filter, documents, id_text, map_arrow, written

MIN_CHARS = 5
MIN_COUNT = 3
RATIO = 2
SYMBOLS = 8
DELETE_EVERY = 97
HELD_WORDS = 200_000                  # of a task's partial counts
FILTER_BITS = 1 << 26                 # of the filter over reduced words: 8 MB
_SHORT = 64                           # bytes; longer runs take zlib's crc32 one by one
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MAYBE = _LETTER.copy()               # bytes that may belong to a run
_MAYBE[0x80:0xC0] = _MAYBE[0xC3] = True


def _crc_table() -> np.ndarray:
    """Remainders of all bytes for the reflected polynomial of crc32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def pieces(col, size: int = kernel.BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, bytes, offsets): texts, long ones cut between runs."""
    for lo, hi, data, offs in kernel.blocks(col, size):
        if hi - lo > 1 or len(data) <= 2 * size:
            yield np.arange(lo, hi), data, offs
            continue
        at = 0
        while at < len(data):
            end = min(len(data), at + size)
            while end < len(data):
                apart = np.flatnonzero(~_MAYBE[data[end:end + 65536]])
                if len(apart):
                    end += int(apart[0])
                    break
                end = min(len(data), end + 65536)
            yield np.array([lo]), data[at:end], np.array([0, end - at])
            at = end


def runs(data: np.ndarray, offs: np.ndarray):
    """(start, end, piece, code points) of every maximal run of letters."""
    inside = _LETTER[data]
    if not inside.all():
        lead = data == 0xC3
        inside |= lead
        inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return start, end, np.searchsorted(offs, start, "right") - 1, heads[end] - heads[start]


def run_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """crc32 of every run, carried on from the crc32 of what stands before it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    state = prefix[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-size, -_SHORT, "left"))       # these are over _SHORT bytes
    for i in range(long):
        own = zlib.crc32(data[start[i]:start[i] + size[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF)
        state[i] = own ^ 0xFFFFFFFF
    for j in range(int(size[long]) if long < len(size) else 0):
        m = int(np.searchsorted(-size, -j, "left"))           # runs of more than j bytes
        s = state[long:m]
        state[long:m] = _CRC[(s ^ data[start[long:m] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty(len(state), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _count(min_chars: int, every: int | None):
    def flush(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            ids = [zlib.crc32(b"%s:" % (b"" if d is None else b"%d" % d)) for d in batch.column("doc_id").to_pylist()]
            before = np.array(ids, np.uint32)
            for rows, data, offs in pieces(batch.column("text")):
                data = kernel.lower(data)
                start, end, piece, chars = runs(data, offs)
                enough = chars >= min_chars
                start, end, piece, chars = start[enough], end[enough], piece[enough], chars[enough]
                if every:
                    crc = run_crc(data, start, end, before[rows[piece]])
                    cut = crc % np.uint32(every) == 0
                    for i in np.flatnonzero(cut & (chars > min_chars)):
                        word, at = data[start[i]:end[i]].tobytes().decode(), int(crc[i]) % int(chars[i])
                        word = (word[:at] + word[at + 1:]).encode()
                        held[word] = held.get(word, 0) + 1
                    start, end = start[~cut], end[~cut]
                _, first, n = np.unique(kernel.span_hash(data, start, end), return_index=True, return_counts=True)
                raw = data.tobytes()
                for a, b, k in zip(start[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
                    word = raw[a:b]
                    held[word] = held.get(word, 0) + k
                if len(held) > HELD_WORDS:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)
    return run


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, delete_every: int | None = None) -> DataFrame:
    """(word, n): letter runs, A-Z lower-cased, of ``min_chars`` code points and
    ``min_count`` occurrences or more; ``delete_every`` thins runs first."""
    words = map_arrow(id_text(docs), _count(min_chars, delete_every), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Reduced:
    """Rolling hashes of reduced words and of their neighbours, for words of one batch."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    STEP = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, words: list[str], symbols: int):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.symbols = symbols
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.s = kernel.mix(points.astype(np.uint64) + np.uint64(1)) % np.uint64(symbols)
        self.row = np.repeat(np.arange(len(words)), self.size)
        at = np.arange(len(points)) - self.first[self.row]
        power = np.full(int(self.size.max(initial=0)) + 2, self.BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        self.up = self.power[at]                                     # of each letter's place
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.s + np.uint64(1)) * self.up, dtype=np.uint64)))
        self.whole = total[self.first[1:]] - total[self.first[:-1]]
        self.before = total[:-1] - total[self.first[self.row]]       # sum of the letters before, in the word

    def _key(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        return kernel.mix(h ^ size.astype(np.uint64) * self.STEP)

    def keys(self) -> np.ndarray:
        return self._key(self.whole, self.size)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of every reduced word one edit away, an array a kind of edit and symbol."""
        one, whole, size = np.uint64(1), self.whole[self.row], self.size[self.row]
        inverse = np.uint64(pow(int(self.BASE), -1, 1 << 64))
        after = whole - self.before - (self.s + one) * self.up       # sum of the letters behind
        yield self.row, self._key(self.before + after * inverse, size - 1)
        words = np.arange(len(self.size))
        for c in range(self.symbols):
            c = np.uint64(c)
            other = self.s != c
            yield self.row[other], self._key((whole + (c - self.s) * self.up)[other], size[other])
            yield self.row, self._key(self.before + (c + one) * self.up + (whole - self.before) * self.BASE, size + 1)
            yield words, self._key(self.whole + (c + one) * self.power[self.size], self.size + 1)


def _chunks(words: list[str], letters: int = 1 << 15) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, w in enumerate(words):
        held += len(w)
        if held > letters:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(words):
        yield lo, len(words)


def _add_key(symbols: int):
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            for lo, hi in _chunks(words):
                keys = pa.array(kernel.signed(Reduced(words[lo:hi], symbols).keys()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, keys], ["word", "n", "key"])
    return run


def _neighbourhoods(symbols: int, shared):
    """(key, near): neighbouring reduced words that may exist, from the smaller key."""
    def run(batches):
        bits = shared.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            for lo, hi in _chunks(words):
                r = Reduced(words[lo:hi], symbols)
                own, found = r.keys(), []
                for row, near in r.neighbours():
                    keep = near.view(np.int64) > own[row].view(np.int64)
                    row, near = row[keep], near[keep]
                    for shift in (np.uint64(0), np.uint64(30)):
                        at = (near >> shift) & np.uint64(FILTER_BITS - 1)
                        keep = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        row, near = row[keep], near[keep]
                    found.append(np.stack((own[row], near)))
                pair = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(x)) for x in pair], ["key", "near"])
    return run


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, b, na, nb): pairs of words exactly one edit apart, each once. ``words``: word, n, key, written."""
    spark = words.sparkSession
    classes = words.groupBy("key").agg(F.min("word").alias("word"), F.count("*").alias("members"))
    mask = F.lit(FILTER_BITS - 1)
    at = F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 30).bitwiseAND(mask))).alias("at")
    shared = spark.sparkContext.broadcast(bit_filter(classes.select(at), FILTER_BITS))
    pairs = map_arrow(classes.select("word"), _neighbourhoods(symbols, shared), "key long, near long")
    pairs = written(pairs, "spelling-classes")
    shared.destroy()
    a = words.select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    b = words.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("nb"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    across = pairs.join(a, "key").join(b, "near").where(one_edit)
    inside = a.join(b, (F.col("key") == F.col("near")) & (F.col("a") < F.col("b"))).where(one_edit)
    return across.select("a", "b", "na", "nb").unionByName(inside.select("a", "b", "na", "nb"))


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n)."""
    words = written(map_arrow(words, _add_key(symbols), "word string, n long, key long"), "spelling-words")
    pairs = written(near_words(words, symbols), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    out = words.select("word", "n").join(best, "word", "left")
    follows = -F.col("best.m") >= ratio * F.col("n")
    out = out.select("word", F.when(follows, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(follows, -F.col("best.m")).alias("form_n"))
    out = written(out, "spelling-forms")
    up = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(6):                      # 2 ** 6 steps: more than a chain of doubling counts can have
        nxt = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        longer = written(up.join(nxt, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")),
                         "spelling-roots")
        up = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    out = out.join(up, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(documents(spark, sf_dir), delete_every=DELETE_EVERY))

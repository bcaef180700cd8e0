"""Substring dedup with a compressed FM-index per shard.

A window is ``LENGTH`` consecutive words. Its words are removed from every
document but the one with the smallest doc_id that has the window.

1. Each window has a minimiser, the smallest hash of a ``SEED``-word gram inside
   it, so equal windows have equal minimisers wherever they stand. Windows in a
   row with the same minimiser form a segment (about a fifth of the words are
   minimisers). Only minimisers that two different texts share matter.
2. Those are put into a bit filter of fixed size. What it lets through by chance
   costs a little work and changes nothing. The segments with such minimisers go
   to the minimiser's shard, each different segment once with its smallest
   doc_id: copies, however many, are combined before the shuffle.
3. A shard is a run of minimisers of about ``SHARD_WORDS`` words in a sorted
   partition. It builds an FM-index of its segments (wavelet matrix with bit
   counts) and streams the same segments through it by backward search. Windows
   matched in more than one row report the smallest doc_id of their interval.
4. The answers go back to the segments' documents by key, and each document's
   removed words are the union of its windows that a smaller doc_id has.

Texts equal as word sequences are one text in step 1, so copies of a whole
document share no minimisers with themselves; all but the first lose all words
by an exact comparison of their word sequence hash (128 bits).

Edge cases: NULL, empty or wordless texts have no words and stay empty. Fewer
than ``LENGTH`` words: no window, nothing goes. Rows that repeat a doc_id are
judged alike: no row removes from another of its own id, and each gives a row.
NULL doc_ids neither remove nor lose words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import kernel
from cadenza.llm.common import documents, id_text, packed_texts, small_batches, unpack, written
from cadenza.llm.fm import FMIndex

LENGTH = 13
SEED = 4
SHARD_WORDS = 300_000
CHUNK_BITS = 19                 # the filter: 256 chunks of 2**19 bits, 16 MB
CHUNKS = 256


def _texts(col):
    """(row, word hashes, word starts, word ends, bytes) of every text."""
    for lo, hi, data, offs in kernel.blocks(col):
        start, end, doc = kernel.words(data, offs)
        h, cut = kernel.span_hash(data, start, end), kernel.bounds(doc, hi - lo)
        for d in range(hi - lo):
            a, b = cut[d], cut[d + 1]
            yield lo + d, h[a:b], start[a:b], end[a:b], data


def minimisers(h: np.ndarray, length: int) -> np.ndarray:
    """The minimiser of every window of one document."""
    g = kernel.gram_hash(h, SEED)
    m = g[:len(h) - length + 1].copy()
    for j in range(1, length - SEED + 1):
        np.minimum(m, g[j:j + len(m)], out=m)
    return m


def _sequence(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _half(b: bytes, k: int) -> int:
    return int.from_bytes(b[8 * k:8 * k + 8], "little", signed=True)


def _seeds(length: int):
    """(minimiser, text hash): the different minimisers of every text, once a batch."""
    def run(batches):
        for batch in batches:
            ms, ts, seen = [], [], set()
            for _, h, *_ in _texts(batch.column("text")):
                if len(h) < length:
                    continue
                t = _half(_sequence(h), 0)
                if t not in seen:
                    seen.add(t)
                    ms.append(np.unique(minimisers(h, length)))
                    ts.append(np.full(len(ms[-1]), t))
            if ms:
                yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(np.concatenate(ms))), pa.array(np.concatenate(ts))], ["m", "t"])
    return run


def _places(m: np.ndarray) -> list[np.ndarray]:
    """Bit places of a minimiser inside its chunk."""
    mask = np.uint64((1 << CHUNK_BITS) - 1)
    return [(m & mask).astype(np.int64), ((m >> np.uint64(CHUNK_BITS)) & mask).astype(np.int64)]


def _chunk_of(m: np.ndarray) -> np.ndarray:
    return (m >> np.uint64(56)).astype(np.int64)


def _chunk_bits(batches):
    """Partial filters: (chunk, bits) of what a task holds."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        m = batch.column("m").to_numpy().view(np.uint64)
        chunk = _chunk_of(m)
        for c in np.unique(chunk):
            own = bits.setdefault(int(c), np.zeros(1 << CHUNK_BITS, bool))
            for p in _places(m[chunk == c]):
                own[p] = True
    for c, own in sorted(bits.items()):
        yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())],
                                         ["chunk", "bits"])


def shared_seeds(text: DataFrame, length: int) -> np.ndarray:
    """The filter of minimisers that stand in two different texts or more."""
    seeds = text.mapInArrow(_seeds(length), "m long, t long").groupBy("m").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    seeds = seeds.where("lo <> hi").select("m")
    chunk = F.shiftrightunsigned("m", 56)
    seeds = seeds.repartition(16, chunk)
    out = np.zeros((CHUNKS, 1 << (CHUNK_BITS - 3)), np.uint8)
    for row in seeds.mapInArrow(_chunk_bits, "chunk long, bits binary").toLocalIterator():     # about CHUNKS rows
        out[row.chunk] |= np.frombuffer(row.bits, np.uint8)
    return out


def _segments(length: int, shared, content: bool):
    """Segments of windows that may repeat. With ``content``: (m, key, doc_id,
    words), else (key, doc_id, t, place): where they stand, t the text's hash."""
    def run(batches):
        keep = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for row, h, start, end, data in _texts(batch.column("text")):
                if len(h) < length or ids[row] is None:
                    continue
                m = minimisers(h, length)
                chunk = _chunk_of(m)
                passed = np.ones(len(m), bool)
                for p in _places(m):
                    passed &= (keep[chunk, p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                if not passed.any():
                    continue
                t = 0 if content else _half(_sequence(h), 0)
                first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
                until = np.append(first[1:], len(m))
                for a, b in zip(first[passed[first]].tolist(), until[passed[first]].tolist(), strict=True):
                    # long runs (repeating texts) are cut, so a segment stays short
                    for s in range(a, b, 64):
                        e = min(s + 64, b) + length - 1
                        key = _sequence(h[s:e])
                        if content:
                            words = b" ".join(data[start[s]:end[e - 1]].tobytes().split())
                            rows.append((int(m[s].view(np.int64)), key, ids[row], words))
                        else:
                            rows.append((key, ids[row], t, s))
                if len(rows) > 50_000:
                    yield _rows(rows, content)
                    rows = []
            yield _rows(rows, content)
    return run


def _rows(rows: list, content: bool) -> pa.RecordBatch:
    fields = ([("m", pa.int64()), ("key", pa.binary()), ("doc_id", pa.int64()), ("words", pa.binary())] if content
              else [("key", pa.binary()), ("doc_id", pa.int64()), ("t", pa.int64()), ("place", pa.int64())])
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _shard(length: int):
    """Streams sorted segments; indexes and searches a shard at a time."""
    def run(batches):
        last, keys, docs, texts, size = None, [], [], [], 0
        for batch in batches:
            out = []
            for m, key, doc, words in zip(*(batch.column(c).to_pylist() for c in ("m", "key", "doc_id", "words")), strict=True):
                if size >= SHARD_WORDS and m != last:
                    out.append(_search(keys, docs, texts, length))
                    keys, docs, texts, size = [], [], [], 0
                last = m
                w = words.split(b" ")
                keys.append(key)
                docs.append(doc)
                texts.append(w)
                size += len(w)
            yield from out
        if keys:
            yield _search(keys, docs, texts, length)
    return run


def _search(keys: list[bytes], docs: list[int], texts: list[list[bytes]], length: int) -> pa.RecordBatch:
    """Per segment, the smallest doc_id that has each of its windows."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    names = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    head = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
    text = np.zeros(int((n + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[head + n] = False
    text[inside] = np.fromiter((names[w] for t in texts for w in t), np.int64, int(n.sum()))
    owner = np.repeat(np.array(docs, np.int64), n + 1)
    windows = n - length + 1
    start = np.repeat(head, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    index = FMIndex(text, length)
    found, lo, hi = index.matches(text, start, length)
    low = owner[start]                               # by place of the window
    if len(found):
        # full-length intervals are equal or apart, so each one's minimum is taken once
        left, first, which = np.unique(lo, return_index=True, return_inverse=True)
        right = hi[first]
        at = np.empty(2 * len(left), np.int64)
        at[::2], at[1::2] = left, right
        rows = np.append(owner[index.rows], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(rows, at)[::2]
        low[np.searchsorted(start, found)] = least[which]
    cut = np.concatenate(([0], np.cumsum(windows)))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(low))], ["key", "low"])


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, t, place) of every window that a document with a smaller id has too."""
    spark = docs.sparkSession
    small_batches(spark)
    text = id_text(docs)
    shared = spark.sparkContext.broadcast(shared_seeds(text, length))
    segments = text.mapInArrow(_segments(length, shared, True), "m long, key binary, doc_id long, words binary")
    segments = segments.groupBy("m", "key").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    segments = segments.repartition("m").sortWithinPartitions("m", "key")
    answers = written(segments.mapInArrow(_shard(length), "key binary, low array<long>"), "window-answers")
    answers = answers.select("key", "low", F.array_min("low").alias("least"))
    stand = text.mapInArrow(_segments(length, shared, False), "key binary, doc_id long, t long, place long")
    hit = stand.join(answers, "key").where("least < doc_id")
    return hit.select("doc_id", "t", F.explode(F.expr(
        "filter(transform(low, (d, i) -> CASE WHEN d < doc_id THEN place + i END), p -> p IS NOT NULL)")).alias("place"))


def _profile(batches):
    """(doc_id, words, sequence hash) of every text."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        rows = [(ids[row], len(h), *(lambda s: (_half(s, 0), _half(s, 1)))(_sequence(h))) for row, h, *_ in _texts(batch.column("text"))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n", "s0", "s1"])


def _remove(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            texts = [unpack(p) for p in batch.column("packed").to_pylist()]
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("marks").to_pylist()
            for row, h, start, end, data in _texts(pa.array(texts, pa.string())):
                gone = np.zeros(len(start) + 1, np.int64)
                own = [x["places"] for x in marks[row] if x["t"] == _half(_sequence(h), 0)] if marks[row] else []
                if any(x is None for x in own) and len(start) >= length:
                    gone = np.ones(len(start), bool)
                else:
                    places = own[0] if own else ()
                    p = np.array(places or (), np.int64)
                    np.add.at(gone, p, 1)
                    np.subtract.at(gone, np.minimum(p + length, len(start)), 1)
                    gone = np.cumsum(gone)[:-1] > 0
                raw = data.tobytes()
                kept = b" ".join([raw[a:b] for a, b in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)])
                rows.append((ids[row], len(start), int(gone.sum()), kept.decode()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                             ["doc_id", "n_words", "n_removed", "text"])
    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one blank."""
    small_batches(docs.sparkSession)
    text = id_text(docs)
    same = written(text.mapInArrow(_profile, "doc_id long, n long, s0 long, s1 long"), "text-profile")
    first = same.where("doc_id IS NOT NULL").groupBy("s0", "s1").agg(F.min("doc_id").alias("first_id"))
    copies = same.join(first, ["s0", "s1"]).where("first_id < doc_id").select("doc_id", "s0", "s1").distinct()
    places = repeated_windows(docs, length)
    # per document: its texts (one, unless rows repeat the id) that are copies, and the windows of the others
    whole = copies.select("doc_id", F.col("s0").alias("t"), F.lit(None).cast("array<long>").alias("places"))
    marks = places.join(whole.select("doc_id", "t"), ["doc_id", "t"], "left_anti")
    marks = marks.groupBy("doc_id", "t").agg(F.collect_set("place").alias("places")).unionByName(whole)
    marks = marks.groupBy(F.col("doc_id").alias("mark_id")).agg(F.collect_list(F.struct("t", "places")).alias("marks"))
    j = packed_texts(docs).join(marks, F.col("doc_id") == F.col("mark_id"), "left").select("doc_id", "packed", "marks")
    return j.mapInArrow(_remove(length), "doc_id long, n_words long, n_removed long, text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

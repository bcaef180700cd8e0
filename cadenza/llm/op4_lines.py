"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus (by doc_id, then place) is within
one edit: equal, or one character replaced, added or left out. Both are judged
on the input, so a line that itself goes can still be the earlier one. White
space at the ends of a line doesn't count. Lines under ``MIN_CHARS`` characters go
only if they are equal; lines without a word stay.

1. Equal lines meet by hash; the first place of each different line is kept.
2. Two lines within one edit share their first or their last half, as counted in
   the shorter one. Only lines that share a half with another line go on, and
   only with the half that may differ.
3. These emit every variant with one character of that half left out, as a hash
   of what is left. A replacement meets in (variant, position); an addition meets
   where one line's variant is the other line whole. In each group all members
   but the earliest are within one edit of the earliest, so the group needs its
   minimum only: no pairs, and groups of any size are summed before the shuffle.
4. The edit distance of each line to its witness is verified on the texts.

Lines, halves and variants are hashed block by block on the bytes or code points
of whole Arrow columns. Where a step needs few of the lines, a filter of fixed
size over their hashes keeps the others in the task; an exact join follows.

The bound is one edit: a line of n characters has n variants then, but n (n - 1) / 2
for two edits (45,000 rows for 300 characters).

Edge cases: NULL or empty text has no lines to remove and stays as it is. Rows
that repeat a doc_id share their places: equal lines in equal places are ties
and all stay. A NULL doc_id sorts first, and all rows without one share their
places too. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import kernel
from cadenza.llm.common import bit_filter, id_text, map_arrow, packed_texts, table, unpack_bytes, written

MIN_CHARS = 20           # of the near step
EXACT_CHARS = 1          # of the exact step
FILTER_BITS = 1 << 26    # of a filter over hashes: 8 MB
BLOCK_BYTES = 1 << 17    # of whole texts at a time: their arrays of 8 bytes a character stay in the cache
_SPACE = " \t\n\x0b\x0c\r"
_WORD_TO_END = re.compile(rb"[^ \t\n\x0b\x0c\r][^\n]*")      # one match in each line with a word
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in _SPACE]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _places_of(col, counted: bool = True):
    """By block: (row, place, start, end) of every line with a word, its white space
    at the ends left off, the block's bytes, and the code points before each byte
    (None unless ``counted``)."""
    for lo, _, data, offs in kernel.blocks(col, BLOCK_BYTES):
        word = np.flatnonzero(~_IS_SPACE[data])
        if not len(word):
            continue
        breaks = np.flatnonzero(data == 0x0A)
        begin = np.unique(np.concatenate((offs[:-1], breaks + 1)))
        # of each line's bytes with a word, the first and the last
        first = np.searchsorted(word, np.append(begin, len(data)))
        some = first[:-1] < first[1:]
        begin = begin[some]
        start, end = word[first[:-1][some]], word[first[1:][some] - 1] + 1
        doc = np.searchsorted(offs, begin, "right") - 1
        place = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offs[doc])
        points = None
        if counted:
            points = np.zeros(len(data) + 1, np.int32)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        yield lo + doc, place, start, end, data, points


def _bits(hashes: DataFrame, name: str):
    """A broadcast filter of a column of hashes."""
    mask = F.lit(FILTER_BITS - 1)
    at = F.explode(F.array(F.col(name).bitwiseAND(mask), F.shiftrightunsigned(name, 30).bitwiseAND(mask))).alias("at")
    return hashes.sparkSession.sparkContext.broadcast(bit_filter(hashes.select(at), FILTER_BITS))


def _likely(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    keep = np.ones(len(h), bool)
    for at in (h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(30)) & np.uint64(FILTER_BITS - 1)):
        keep &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return keep


def _columns(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(kernel.signed(a) if a.dtype == np.uint64 else a) for a in arrays],
                                      names.split())


def _places(min_chars: int, shared=None):
    """(line hash, doc_id, place) of every line; with ``shared``, of those its filter holds."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, place, start, end, data, points in _places_of(batch.column("text"), min_chars > 1):
                if points is not None:          # a line with a word has one character
                    keep = points[end] - points[start] >= min_chars
                    row, place, start, end = row[keep], place[keep], start[keep], end[keep]
                h = kernel.span_hash(data, start, end)
                if shared is not None:
                    keep = _likely(shared.value, h)
                    h, row, place = h[keep], row[keep], place[keep]
                yield _columns("line doc_id place", h, ids.take(pa.array(row)), place.astype(np.int32))
    return run


def _halves(data: np.ndarray, points: np.ndarray, total: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(key, side) of every line, as the shorter and as the longer of a pair; side
    0: the first half is equal, so the edit is in the rest; 1: the other way."""
    heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first, n = points[start], points[end] - points[start]
    for less in (0, 1):
        m = n - less
        q = m // 2
        salt = kernel.mix(m.astype(np.int64).astype(np.uint64) * _STEP + np.uint64(1))
        yield kernel.mix(kernel.span_hash(data, start, heads[first + q], total) ^ salt), 0
        yield kernel.mix(kernel.span_hash(data, heads[first + n - q], end, total) ^ ~salt), 1


def _keys(min_chars: int, shared=None):
    """(key, line, side) of every line, once a block; with ``shared``, of the keys its filter holds."""
    def run(batches):
        for batch in batches:
            for _, _, start, end, data, points in _places_of(batch.column("text")):
                keep = points[end] - points[start] >= min_chars
                start, end = start[keep], end[keep]
                if not len(start):
                    continue
                total = kernel.running_hash(data)
                h, first = np.unique(kernel.span_hash(data, start, end, total), return_index=True)
                for key, side in _halves(data, points, total, start[first], end[first]):
                    keep = slice(None) if shared is None else _likely(shared.value, key)
                    yield _columns("key line side", key[keep], h[keep], np.full(len(h[keep]), side, np.int32))
    return run


def _texts(min_chars: int, shared):
    """(line, doc_id, place, text): of every line that the filter holds, the first place in the batch."""
    def run(batches):
        for batch in batches:
            rows = []
            ids = batch.column("doc_id")
            none = ids.is_null().to_numpy(zero_copy_only=False)
            order = ids.fill_null(0).to_numpy()
            for row, place, start, end, data, points in _places_of(batch.column("text")):
                keep = points[end] - points[start] >= min_chars
                row, place, start, end = row[keep], place[keep], start[keep], end[keep]
                h = kernel.span_hash(data, start, end)
                keep = np.flatnonzero(_likely(shared.value, h))
                if not len(keep):
                    continue
                keep = keep[np.lexsort((place[keep], order[row[keep]], ~none[row[keep]], h[keep]))]
                keep = keep[np.diff(h[keep], prepend=h[keep][0] + np.uint64(1)) != 0]
                raw = data.tobytes()
                rows.append(_columns("line doc_id place text", h[keep], ids.take(pa.array(row[keep])), place[keep].astype(np.int32), pa.array(
                    [raw[a:b].decode() for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)], pa.string())))
            yield from rows
    return run


def variant_hashes(lines: list[str], sides: list[set[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the line, position, hash): of every line whole (position -1) and
    with one character left out, in the halves that may differ."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.concatenate(([0], np.cumsum(n)))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(lines)), n)
    at = np.arange(len(points)) - first[row]
    up = np.full(int(n.max(initial=0)) + 1, _BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)[at]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * up, dtype=np.uint64)))
    whole = total[first[1:]] - total[first[:-1]]
    before = total[:-1] - total[first[row]]
    after = (whole[row] - before - points * up) * np.uint64(pow(int(_BASE), -1, 1 << 64))
    left = kernel.mix((before + after) ^ (n[row] - 1).astype(np.uint64) * _STEP)
    q = (n - 1) // 2
    low = np.array([s == {0} for s in sides], bool)
    high = np.array([s == {1} for s in sides], bool)
    keep = np.where(low[row], at >= q[row], True) & np.where(high[row], at < (n - q)[row], True)
    every = np.arange(len(lines))
    return (np.concatenate((every, row[keep])), np.concatenate((np.full(len(lines), -1), at[keep])),
            np.concatenate((kernel.mix(whole ^ n.astype(np.uint64) * _STEP), left[keep])))


def _variants(batches):
    """(variant, position, line, doc_id, place) of every wanted line, some 100,000 characters at a time."""
    for batch in batches:
        texts, sides = batch.column("text").to_pylist(), batch.column("sides").to_pylist()
        h, ids, place = batch.column("line"), batch.column("doc_id"), batch.column("place")
        lo, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > 100_000 or i == len(texts) - 1:
                row, at, v = variant_hashes(texts[lo:i + 1], [set(s) for s in sides[lo:i + 1]])
                take = pa.array(lo + row)
                yield _columns("variant position line doc_id place", v, at.astype(np.int32), h.take(take), ids.take(take), place.take(take))
                lo, held = i + 1, 0


def near_lines(docs: DataFrame, first: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line, witness): different lines with an earlier one within one edit."""
    text = id_text(docs)
    kind = "key long, line long, side int"
    shared = map_arrow(text, _keys(min_chars), kind).groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    shared = written(shared.where("a <> b").select("key"), "line-halves")
    bits = _bits(shared, "key")
    keys = map_arrow(text, _keys(min_chars, bits), kind)
    wanted = keys.join(shared, "key", "left_semi").groupBy("line").agg(F.collect_set("side").alias("sides"))
    wanted = written(wanted.join(first, "line").select("line", "doc_id", "place", "sides"), "line-wanted")
    bits.destroy()
    bits = _bits(wanted, "line")
    # every task sends the first place it saw; the join on line, doc_id and place keeps the corpus's first
    texts = map_arrow(text, _texts(min_chars, bits), "line long, doc_id long, place int, text string")
    w = wanted.select(F.col("line").alias("wl"), F.col("doc_id").alias("wd"), F.col("place").alias("wp"), "sides")
    texts = texts.join(w.hint("merge"), (F.col("line") == F.col("wl")) & F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("place") == F.col("wp")))
    texts = written(texts.select("line", "doc_id", "place", "sides", "text").dropDuplicates(["line"]), "line-texts")
    bits.destroy()
    # one exchange by variant serves the groups and the joins
    v = map_arrow(texts, _variants, "variant long, position int, line long, doc_id long, place int").repartition("variant")
    at = F.struct("doc_id", "place", "line")
    groups = v.groupBy("variant", "position").agg(F.min(at).alias("top"), F.max("line").alias("hi"), F.min("line").alias("lo"))
    groups = groups.where("position >= 0 AND lo <> hi").select(F.col("variant").alias("gv"), F.col("position").alias("gp"), "top")
    replaced = v.join(groups, [F.col("variant") == F.col("gv"), F.col("position") - F.col("gp") == 0])
    whole = v.where("position < 0").select(F.col("variant").alias("wv"), at.alias("whole"))
    longer = v.where("position >= 0").withColumn("at", at).join(whole, F.col("variant") == F.col("wv"))
    later = [replaced.where("top.line <> line").select("line", F.col("top.line").alias("witness")),
             longer.where("whole < at").select("line", F.col("whole.line").alias("witness")),
             longer.where("whole > at").groupBy(F.col("whole.line").alias("line")).agg(F.min("at").alias("top")).select(
                 "line", F.col("top.line").alias("witness"))]
    pairs = later[0].unionByName(later[1]).unionByName(later[2]).where("line <> witness").distinct()
    a, b = texts.select("line", F.col("text").alias("a")), texts.select(F.col("line").alias("witness"), F.col("text").alias("b"))
    near = pairs.join(a, "line").join(b, "witness").where(F.levenshtein("a", "b", 1) >= 0)
    return near.groupBy("line").agg(F.min("witness").alias("witness"))


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, place) of every line that goes; equal lines from ``exact_chars``
    characters on (``min_chars`` if not given)."""
    least, kind = max(1, min_chars if exact_chars is None else exact_chars), "line long, doc_id long, place int"
    at = F.struct("doc_id", "place")
    first = map_arrow(id_text(docs), _places(least), kind).groupBy("line").agg(F.min(at).alias("at"), F.max(at).alias("last"))
    first = written(first.select("line", "at.doc_id", "at.place", (F.col("at") < F.col("last")).alias("again")), "line-first")
    near = written(near_lines(docs, first, min_chars), "line-near")
    # only lines in several places, and near ones, can go
    f = first.join(near.select("line", F.lit(True).alias("near")), "line", "left").where("again OR near").select(
        "line", at.alias("first_at"), F.coalesce("near", F.lit(False)).alias("near"))
    f = written(f, "line-gone")
    places = map_arrow(id_text(docs), _places(least, _bits(f, "line")), kind)
    gone = places.join(f, "line").where("near OR first_at < struct(doc_id, place)")
    return gone.select("doc_id", "place").distinct()


def _cut(batches):
    for batch in batches:
        texts, n_lines, n_removed = [], [], []
        for packed, gone in zip(batch.column("packed").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            raw, gone = unpack_bytes(packed), set(gone or ())
            texts.append(b"\n".join(line for k, line in enumerate(raw.split(b"\n")) if k not in gone) if gone else raw)
            n_lines.append(len(_WORD_TO_END.findall(raw)))
            n_removed.append(len(gone))
        rest = ["doc_id", *(["rest"] if "rest" in batch.schema.names else [])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                                          pa.array(n_removed, pa.int64())], [*rest, "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, rest: bool = False, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """doc_id, text without the lines that go, lines with a word, lines removed;
    with ``rest``, the other columns as a struct."""
    gone = removed_lines(docs, min_chars, exact_chars).groupBy("doc_id").agg(F.collect_set("place").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), "gone")
    j = packed_texts(docs, rest)
    kind = [f"rest {t}" for n, t in j.dtypes if n == "rest"]
    # a merge join: the tasks that unpack are others than those that pack
    j = j.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").drop("gone_id")
    return map_arrow(j, _cut, ", ".join(["doc_id long", *kind, "text string, n_lines long, n_removed long"]))


def clean_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, with the columns they had, without the lines that go. A
    document that loses lines and has no word left is dropped; ``n_chars``, where
    there is one, is counted anew."""
    out = dedup_lines(docs, min_chars, True).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]") | (F.col("n_removed") == 0))
    columns = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result carries a hash of the text that is left, not the text."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

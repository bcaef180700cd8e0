"""Scoring with a class-based bigram model (Brown classes found by exchange).

Learning, all of it counted over every training document: word counts; every
word seen ``MIN_COUNT`` times or more is a unit of its own, rarer words belong to
one of ``TAILS`` units by a hash of their last two bytes, and the end is a unit.
Every text is written once as numbers of units, with what its score has that no
class changes. Unit pairs are counted in the tasks, and travel and are kept as
packed blocks by part of the units, a block holding all neighbours of its units.
The exchange clustering starts from units dealt by rank
and runs as its distributed form does (Uszkoreit and Brants 2008): each worker
holds the neighbours of a share of the units and a copy of the class map (one
byte a unit). In each round it sums each unit's neighbours by class and works out
its best class against the class table of the last round, and half of the units
may move; a round that lowers the likelihood is undone and fewer units may move.
It ends when no move gains, or a round gains under ``TOLERANCE`` nats a token. The
driver holds the class map and the table of class pairs, never pairs of units.

Model: P(w | v) = P(class w | class v) P(unit | class) P(w | unit). Transitions
are interpolated with the class shares (weight ``MU``), the other two have half
a count added, with one unseen word a tail unit.

Words are numbered by falling count. The ``CACHED`` first come from a broadcast of
fixed size; a text's other words go through a join with the count table, and come
back to it by a hash of the text, so that copies, or rows without an id, make no
group of their own.

Edge cases: NULL or empty text is the end alone. Rows that repeat a doc_id are
one document: its texts' tokens and scores are added up, each with its own
end. A NULL doc_id is scored (all such rows as one document), is not
held out and, as all others, learnt from. With no training
documents N and V are 0 and every factor falls back to its added counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import kernel
from cadenza.llm.common import crc_mod, documents, id_text, map_arrow, packed, unpack, written

MIN_COUNT = 5
TAILS = 256
CLASSES = 48
CACHED = 1 << 18
TOLERANCE = 1e-3
MU = 50.0
PART_TOKENS = 400_000                    # of the training tokens, for each part of the units
SMALL = 32                               # counts whose part of a gain is looked up
HELD_PAIRS = 2_000_000                   # of a task, before it adds equal ones up
END = np.uint64(0x5DEECE66D1CE4E5B)      # the end's "word hash"


def _hashed(col):
    """(first row, texts, hash of every word, tail unit by its ending, document cuts) by block."""
    for lo, hi, data, offs in kernel.blocks(col):
        data = kernel.lower(data)
        start, end, doc = kernel.words(data, offs)
        tail = kernel.span_hash(data, np.maximum(start, end - 2), end) % np.uint64(TAILS)
        yield lo, hi - lo, kernel.span_hash(data, start, end), tail.astype(np.int64), kernel.bounds(doc, hi - lo)


def _count_words(batches):
    for batch in batches:
        parts, tails = [], []
        for _, _, h, tail, _ in _hashed(batch.column("text")):
            parts.append(h)
            tails.append(tail)
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        keys, first, n = np.unique(h, return_index=True, return_counts=True)
        tail = np.concatenate(tails)[first] if parts else np.zeros(0, np.int64)
        keys, n, tail = np.append(keys, END), np.append(n, len(batch)), np.append(tail, TAILS)
        yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(keys)), pa.array(tail), pa.array(n.astype(np.int64))], ["h", "tail", "c"])


class Lookup:
    """Counts and numbers of some words, by hash."""

    def __init__(self, h: np.ndarray, c: np.ndarray, number: np.ndarray):
        order = np.argsort(h)
        self.h, self.c, self.number = h[order], c[order], number[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or 0, whether it is there)."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        pos = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return pos, self.h[pos] == h

    def units(self, h: np.ndarray, tail: np.ndarray, n_words: int):
        """(unit, count, whether the word is there); words that aren't get their tail unit."""
        pos, there = self.find(h)
        if not len(self.h):
            return n_words + tail, np.zeros(len(h), np.int64), there
        own = there & (self.number[pos] < n_words)
        return np.where(own, self.number[pos], n_words + tail), np.where(there, self.c[pos], 0), there


def _with_ends(units: np.ndarray, cut: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence with an end after every document, and where each begins."""
    out = np.insert(units, cut[1:], end)
    return out, cut[:-1] + np.arange(len(cut) - 1)


def _pack_pairs(own: np.ndarray, other: np.ndarray, n: np.ndarray) -> bytes:
    """Unit pairs in order of their own unit, compressed."""
    import zstandard

    raw = np.diff(own, prepend=0).astype(np.int32).tobytes() + other.astype(np.int32).tobytes() + n.astype(np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack_pairs(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    m = len(raw) // 16
    return (np.cumsum(np.frombuffer(raw, np.int32, m), dtype=np.int64), np.frombuffer(raw, np.int32, m, 4 * m),
            np.frombuffer(raw, np.int64, m, 8 * m))


def _by_part(own: np.ndarray, other: np.ndarray, n: np.ndarray, parts: int):
    """(part, packed pairs) by the part of the own unit, as lists."""
    part = own % parts
    order = np.argsort((part * (int(own.max(initial=0)) // parts + 1) + own // parts) << 32 | other)
    own, other, n, part = own[order], other[order], n[order], part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    last = np.append(first[1:], len(part))
    return part[first].tolist(), [_pack_pairs(own[a:b], other[a:b], n[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def _count_pairs(end: int, parts: int):
    """(part, 0, packed) pairs of a unit and the next in a document, ends around it, counted in the task."""
    def flush(held):
        k, n = np.unique(np.concatenate(held), return_counts=True)
        part, packed = _by_part(k >> 32, k & 0xFFFFFFFF, n, parts)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(packed, pa.binary())], ["part", "packed"])

    def run(batches):
        import zstandard

        d, held, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for raw in batch.column("units").to_pylist():
                seq = np.concatenate(([end], np.frombuffer(d.decompress(raw), np.int32), [end])).astype(np.int64)
                held.append(seq[:-1] << 32 | seq[1:])
                size += len(held[-1])
                if size > HELD_PAIRS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)
    return run


def _merge(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of several blocks added up, in order."""
    own, other, n = (np.concatenate(x) for x in zip(*map(_unpack_pairs, blocks), strict=True))
    key = own << 32 | other
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(n[order], first)


def _followers(parts: int):
    """A part's pairs added up: whole as (part, after), and turned round, each by the part of its second unit."""
    def run(group: pa.Table) -> pa.Table:
        own, other, n = _merge(group.column("packed").to_pylist())
        part, packed = _by_part(other.astype(np.int64), own, n, parts)
        here = group.column("part")[0].as_py()
        return pa.table({"part": pa.array([here, *part], pa.int64()), "after": pa.array([_pack_pairs(own, other, n), *[None] * len(part)], pa.binary()),
                         "before": pa.array([None, *packed], pa.binary())})
    return run


def _both_sides(group: pa.Table) -> pa.Table:
    after = [x for x in group.column("after").to_pylist() if x is not None]
    before = _merge([x for x in group.column("before").to_pylist() if x is not None])
    return pa.table({"after": pa.array(after, pa.binary()), "before": pa.array([_pack_pairs(*before)], pa.binary())})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _likelihood(pairs: np.ndarray) -> float:
    """Class part of the log likelihood; the words' own part doesn't depend on classes."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(1)).sum() - _xlogx(pairs.sum(0)).sum())


def _class_sums(packed: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, units x classes): the neighbours of a part's units on one side, by class."""
    own, other, n = _unpack_pairs(packed)
    new = np.diff(own, prepend=-1) != 0
    code = (np.cumsum(new) - 1) * CLASSES + classes[other]
    units = own[new]
    return units, np.bincount(code, weights=n, minlength=len(units) * CLASSES).reshape(-1, CLASSES)


def _table_rows(shared):
    def run(batches):
        classes, table = shared.value, np.zeros((CLASSES, CLASSES))
        for batch in batches:
            for packed in batch.column("after").to_pylist():
                units, sums = _class_sums(packed, classes)
                np.add.at(table, classes[units], sums)
        i, j = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(table[i, j].astype(np.int64))], ["i", "j", "n"])
    return run


def class_table(near: DataFrame, shared) -> np.ndarray:
    """Counts of class pairs, summed by Spark."""
    rows = map_arrow(near.select("after"), _table_rows(shared), "i long, j long, n long")
    out = np.zeros((CLASSES, CLASSES))
    for r in rows.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():     # CLASSES x CLASSES rows
        out[r.i, r.j] = r.n
    return out


def _steps(table: np.ndarray) -> list[np.ndarray]:
    """For both sides: what 1, 2, ... more add to x log x of each cell of the class table."""
    more = np.arange(1, SMALL + 1)[:, None, None]
    return [_xlogx(down[None] + more) - _xlogx(down)[None] for down in (table.T, table)]


def _gains(sums, own_class: np.ndarray, table: np.ndarray, steps: list[np.ndarray] | None = None) -> np.ndarray:
    """Gain of moving each unit (a row of both sums) to each class, against the given class table."""
    steps = steps or _steps(table)
    after, before = sums
    own, gain = after.sum(1), np.zeros_like(after)
    for side, t, step in ((after, table, steps[0]), (before, table.T, steps[1])):
        total, down = t.sum(1), np.ascontiguousarray(t.T)
        flat = _xlogx(down)
        here = t[own_class]
        leave = (_xlogx(np.maximum(here - side, 0)) - _xlogx(here)).sum(1)
        leave -= _xlogx(np.maximum(total[own_class] - own, 0)) - _xlogx(total[own_class])
        gain += leave[:, None] - (_xlogx(total + own[:, None]) - _xlogx(total))
        row, c = np.nonzero(side)                      # only the classes a unit meets count
        met = side[row, c].astype(np.int64)
        large = np.flatnonzero(met > SMALL)            # most units meet a class a few times only
        x = step[np.minimum(met, SMALL) - 1, c]
        y = down[c[large]] + met[large][:, None]
        x[large] = y * np.log(y) - flat[c[large]]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if len(first):
            gain[row[first]] += np.add.reduceat(x, first)
    gain[np.arange(len(own)), own_class] = 0
    return gain


def _wishes(shared, table: np.ndarray):
    """Units that gain by a move and their best class, as packed numbers."""
    def run(batches):
        classes, steps = shared.value, _steps(table)
        for batch in batches:
            for after, before in zip(batch.column("after").to_pylist(), batch.column("before").to_pylist(), strict=True):
                unit, sums = _class_sums(after, classes)       # every unit has neighbours on both sides, at least an end
                gain = _gains((sums, _class_sums(before, classes)[1]), classes[unit], table, steps)
                gain[:, CLASSES - 1] = -np.inf             # the end keeps a class of its own
                to = gain.argmax(1)
                move = (gain[np.arange(len(to)), to] > 1e-9) & (unit != len(classes) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([unit[move].astype(np.int32).tobytes()], pa.binary()),
                                                  pa.array([to[move].astype(np.int8).tobytes()], pa.binary())], ["unit", "best"])
    return run


def exchange(near: DataFrame, n_units: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of every unit, class pair counts); ``near``: packed neighbours on both sides, a row a part of the units."""
    sc = near.sparkSession.sparkContext
    classes = (np.arange(n_units) % (CLASSES - 1)).astype(np.int8)
    classes[-1] = CLASSES - 1
    shared = sc.broadcast(classes)
    table = class_table(near, shared)
    best, share, k, wishes = _likelihood(table), 2, 0, None
    while True:
        if wishes is None:
            found = map_arrow(near, _wishes(shared, table), "unit binary, best binary").collect()
            wishes = [np.frombuffer(b"".join(bytes(r[i]) for r in found), t) for i, t in ((0, np.int32), (1, np.int8))]
        pick = (wishes[0].astype(np.int64) * 2654435761 + k * 40503) // 64 % share == 0
        k += 1
        if not pick.any():
            break
        moved = classes.copy()
        moved[wishes[0][pick]] = wishes[1][pick]
        new_shared = sc.broadcast(moved)
        new_table = class_table(near, new_shared)
        now = _likelihood(new_table)
        if now > best:
            small = now - best < TOLERANCE * table.sum()
            shared.unpersist()
            classes, shared, table, best, wishes = moved, new_shared, new_table, now, None
            if small:
                break
        else:
            new_shared.unpersist()
            share *= 2
    shared.unpersist()
    return classes, table


class Vocabulary:
    """The most frequent words and what all words need: arrays of fixed size; log10 throughout."""

    def __init__(self, lookup: Lookup, n_words: int, tail_n, tail_v, end_count: int, n: int, v: int):
        self.lookup, self.n_words, self.end_count, self.n, self.v = lookup, n_words, end_count, n, v
        self.tail_n = tail_n
        self.tail = tail_n + 0.5 * (tail_v + 1)    # of each tail unit: its words' denominator
        self.total = n + 0.5 * (v + 1)


class Model:
    """The class map and the tables of class pairs."""

    def __init__(self, vocabulary: Vocabulary, classes, table):
        self.vocabulary, self.n_words, self.classes, self.n = vocabulary, vocabulary.n_words, classes, vocabulary.n
        size, mass = np.bincount(classes, minlength=CLASSES), table.sum(0)
        share = (mass + 0.5) / (mass.sum() + 0.5 * CLASSES)
        self.step = np.log10((table + MU * share[None, :]) / (table.sum(1)[:, None] + MU))
        self.within = np.log10(mass + 0.5 * size)  # of each class: its units' denominator


def numbered(counts: DataFrame) -> DataFrame:
    """All words (h, tail, c) with their number by falling count, as a written table."""
    ranked = counts.where(F.col("tail") < TAILS).orderBy(F.desc("c"), "h").withColumn("at", F.monotonically_increasing_id())
    ranked = written(ranked, "lm-ranked").withColumn("part", F.shiftright("at", 33))
    first, parts = 0, []
    for r in ranked.groupBy("part").count().orderBy("part").collect():         # one row a partition
        parts.append((r.part, first - (r.part << 33)))
        first += r["count"]
    parts = counts.sparkSession.createDataFrame(parts, "part long, shift long")
    return ranked.join(F.broadcast(parts), "part").select("h", "tail", "c", (F.col("at") + F.col("shift")).alias("number"))


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame, DataFrame]:
    """The vocabulary, the counts of all words (h, tail, c) and their numbers, as written tables."""
    counts = map_arrow(id_text(docs), _count_words, "h long, tail long, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))
    counts = written(counts.where("c > 0"), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_words = counts.where((F.col("tail") < TAILS) & (F.col("c") >= MIN_COUNT)).count()
    words = written(numbered(counts), "lm-words")
    top = words.where(F.col("number") < CACHED).select("h", "c", "number").toPandas()
    lookup = Lookup(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), top["number"].to_numpy(np.int64))
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.where((F.col("tail") < TAILS) & (F.col("c") < MIN_COUNT)).groupBy("tail").agg(
            F.sum("c").alias("n"), F.count("*").alias("v")).collect():         # TAILS rows
        tail_n[r.tail], tail_v[r.tail] = r.n, r.v
    end = counts.where(F.col("tail") == TAILS).first()
    return Vocabulary(lookup, n_words, tail_n, tail_v, int(end.c) if end else 0, int(total.n or 0), int(total.v)), counts, words


_SEQUENCE = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, units binary"


def _encode(shared):
    """A document's units and what its score has that no class changes: the base
    score, and log10 of every token's count in its unit and of its unit's count.
    ``found`` has the words of the document that the broadcast hasn't."""
    def run(batches):
        import zstandard

        vocab, z = shared.value, zstandard.ZstdCompressor(level=1)
        n_words, end = vocab.n_words, math.log10(vocab.end_count + 0.5)
        for batch in batches:
            text, more = batch.column("text") if "text" in batch.schema.names else pa.array(
                [unpack(x) for x in batch.column("packed").to_pylist()], pa.string()), None
            if "found" in batch.schema.names:
                f = batch.column("found").flatten()
                h, first = np.unique(f.field("h").to_numpy().view(np.uint64), return_index=True)
                more = Lookup(h, f.field("c").to_numpy()[first], f.field("number").to_numpy()[first])
            for lo, m, h, tail, cut in _hashed(text):
                units, c, there = vocab.lookup.units(h, tail, n_words)
                if more is not None:
                    units_, c_, there_ = more.units(h, tail, n_words)
                    units, c, there = np.where(there, units, units_), np.where(there, c, c_), there | there_
                rare = units >= n_words
                of_tail = np.where(rare, units - n_words, 0)
                own = np.log10(np.where(rare, vocab.tail_n[of_tail], c) + 0.5) + np.where(rare, np.log10((c + 0.5) / vocab.tail[of_tail]), 0.0)
                units = units.astype(np.int32)
                packed = [z.compress(units[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                columns = [np.diff(cut) + 1, _per_document(there.astype(np.int64), cut) + (vocab.end_count > 0),
                           _per_document(np.log10((c + 0.5) / vocab.total), cut) + end - math.log10(vocab.total), _per_document(own, cut) + end]
                yield pa.RecordBatch.from_arrays([batch.column(x).slice(lo, m) for x in ("doc_id", "held_out")] + [*map(pa.array, columns), pa.array(packed, pa.binary())],
                                                 [c.split()[0] for c in _SEQUENCE.split(", ")])
    return run


def encode(docs: DataFrame, vocab: Vocabulary, words: DataFrame) -> DataFrame:
    """Every row's text as numbers of units, written; ``docs``: doc_id, text, held_out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    if vocab.v <= CACHED:
        return written(map_arrow(docs, _encode(shared), _SEQUENCE), "lm-sequences")
    # texts meet the counts of their own rare words by the text, so copies and rows without an id are no group
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    found = map_arrow(docs.select(key, "text"), _other_words(shared), "key long, h long").join(
        words.where(F.col("number") >= CACHED).select("h", "c", "number"), "h")
    found = found.groupBy(F.col("key").alias("found_key")).agg(F.collect_set(F.struct("h", "c", "number")).alias("found"))
    # a merge join: the tasks that unpack are others than those that pack
    joined = packed(docs.select("doc_id", "held_out", key, "text")).join(found.hint("merge"), F.col("key") == F.col("found_key"), "left")
    joined = joined.select("doc_id", "held_out", "packed", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
    return written(map_arrow(joined, _encode(shared), _SEQUENCE), "lm-sequences")


def fit(sequences: DataFrame, vocab: Vocabulary) -> Model:
    """The classes of all units, from the sequences that aren't held out."""
    end = vocab.n_words + TAILS
    parts = max(1, -(-vocab.n // PART_TOKENS))
    pairs = map_arrow(sequences.where("NOT held_out").select("units"), _count_pairs(end, parts), "part long, packed binary")
    near = pairs.groupBy("part").applyInArrow(_followers(parts), "part long, after binary, before binary")
    near = near.groupBy("part").applyInArrow(_both_sides, "after binary, before binary")
    return Model(vocab, *exchange(written(near, "lm-neighbours"), end + 1))


def learn(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the counts of all words (h, tail, c) and their numbers, as written tables."""
    vocab, counts, words = vocabulary(docs)
    return fit(encode(_marked(docs), vocab, words), vocab), counts, words


def _marked(docs: DataFrame, held=None) -> DataFrame:
    return id_text(docs).withColumn("held_out", F.lit(False) if held is None else held)


_ROW = "doc_id long, n_tokens long, n_known long, base double, score double"


def _scored(shared):
    def run(batches):
        import zstandard

        (n_words, classes, step, within), d = shared.value, zstandard.ZstdDecompressor()
        end = n_words + TAILS
        for batch in batches:
            units = [np.frombuffer(d.decompress(x), np.int32) for x in batch.column("units").to_pylist()]
            if not units:
                continue
            cut = np.concatenate(([0], np.cumsum([len(u) for u in units])))
            seq, first = _with_ends(np.concatenate(units), cut, end)
            cls = classes[seq]
            lp = step[np.concatenate(([classes[end]], cls[:-1])), cls] - within[cls]
            score = np.add.reduceat(lp, first) + batch.column("emit").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "base")), pa.array(score)],
                                             [c.split()[0] for c in _ROW.split(", ")])
    return run


def _per_document(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of ``x`` by document."""
    total = np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))
    return total[cut[1:]] - total[cut[:-1]]


def _other_words(shared):
    """(key, word) of the words that aren't cached, once a text."""
    def run(batches):
        lookup = shared.value.lookup
        for batch in batches:
            keys = batch.column("key")
            for lo, _, h, _, cut in _hashed(batch.column("text")):
                at = np.flatnonzero(~lookup.find(h)[1])
                doc = np.searchsorted(cut, at, "right") - 1
                order = np.lexsort((h[at], doc))
                at, doc = at[order], doc[order]
                new = np.ones(len(at), bool)
                new[1:] = (h[at[1:]] != h[at[:-1]]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(lo + doc[new])), pa.array(kernel.signed(h[at[new]]))], ["key", "h"])
    return run


def score_sequences(sequences: DataFrame, model: Model) -> DataFrame:
    shared = sequences.sparkSession.sparkContext.broadcast((model.n_words, model.classes, model.step, model.within))
    out = map_arrow(sequences, _scored(shared), _ROW).groupBy("doc_id").agg(
        *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
                      F.col("base").alias("base_score"), "score")


def score(docs: DataFrame, model: Model, counts: DataFrame, words: DataFrame) -> DataFrame:
    return score_sequences(encode(_marked(docs), model.vocabulary, words), model)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    vocab, _, words = vocabulary(docs.where(~held))
    sequences = encode(_marked(docs, held), vocab, words)
    scored = score_sequences(sequences, fit(sequences, vocab))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         perplexity.alias("perplexity"))

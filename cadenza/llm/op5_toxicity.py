"""Toxic passages by maximum-scoring segments.

Learning (labelled rows outside the held-out remainder, at most ``TRAIN_ROWS`` of
them in order of a hash of the id): each word stands for itself and for its
first 4 to 6 bytes. Every such feature gets a log-odds ratio, toxic against
clean texts, with an informative Dirichlet prior (the feature's share of all
text, of a weight that is ``PRIOR_SHARE`` of all counts, documents with the feature), and its z-score.
Features with ``MIN_Z`` or more, the strongest ``MAX_FEATURES`` of them, are the
model, so its size has a fixed bound. A token scores as its feature with the
largest absolute z, less a ``DRIFT``.

Scoring: a linear-time scan finds all maximal scoring segments of a text. For
segments by chance in clean text, lambda solves sum p(s) exp(lambda s) = 1 over
the clean token scores and K is their density, so K n exp(-lambda S) segments of
score S are expected in n tokens. A document's evidence is the sum of
lambda S - ln(K n) over its segments where positive; a logistic curve fitted on
the training rows turns log(1 + evidence) into a probability.

Edge cases: NULL, empty and wordless texts have no evidence and get the curve's
value at zero. Without any labelled row of both classes every score is the
smoothed share of toxic labels (a half without labels). Rows that repeat an id
are scored each; a NULL id is scored and counts as not held out. Labels that
repeat an id or are NULL: the largest label of an id counts, NULLs are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import kernel
from cadenza.llm.common import crc_mod, documents, id_text, small_batches, table, written

TRAIN_ROWS = 200_000
MAX_FEATURES = 65_536
MIN_Z = 4.0
PRIOR_SHARE = 0.1
DRIFT = 0.1
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
BIN = 0.05                         # width of the histograms of token scores and of evidence
_SPLIT = np.zeros(256, bool)       # ASCII but letters and digits
_SPLIT[:0x30] = _SPLIT[0x3A:0x41] = _SPLIT[0x5B:0x61] = _SPLIT[0x7B:0x80] = True


def _features(data: np.ndarray, offs: np.ndarray):
    """(document of each word, [feature hashes of the words, with a mask])."""
    data = kernel.lower(data)
    start, end, doc = kernel.words(data, offs, _SPLIT)
    out = [(kernel.span_hash(data, start, end), np.ones(len(start), bool))]
    for k in PREFIXES:
        longer = end - start > k
        out.append((kernel.span_hash(data, start, np.minimum(start + k, end)) ^ np.uint64(k), longer))
    return doc, out


def _count(batches):
    """(feature, toxic, clean): labelled documents with each feature; feature 0 is the sum over all."""
    for batch in batches:
        label = np.array(batch.column("toxic").to_pylist(), np.int64)
        for lo, hi, data, offs in kernel.blocks(batch.column("text")):
            doc, features = _features(data, offs)
            h = np.concatenate([x[m] for x, m in features])
            at = np.concatenate([doc[m] for _, m in features])
            order = np.lexsort((at, h))
            h, at = h[order], at[order]
            own = np.ones(len(h), bool)               # a feature counts once a document, so no one text makes it
            own[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
            h, t = h[own], (label[lo:hi] > 0)[at[own]]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            keys = h[first]
            yes = np.add.reduceat(t.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            both = np.diff(np.append(first, len(h)))
            keys = np.append(keys, np.uint64(0))
            yes, both = np.append(yes, t.sum()), np.append(both, len(t))
            yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(keys)), pa.array(yes), pa.array(both - yes)],
                                             ["feature", "toxic", "clean"])


@dataclass
class Model:
    keys: np.ndarray               # sorted feature hashes
    odds: np.ndarray
    z: np.ndarray
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    base: float = 0.0

    def prepare(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def token_scores(self, features) -> np.ndarray:
        n = len(features[0][0])
        best, score = np.zeros(n), np.zeros(n)
        for h, mask in features:
            at = np.flatnonzero(mask & self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(at):
                continue
            pos = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[pos] == h[at]
            at, pos = at[hit], pos[hit]
            better = np.abs(self.z[pos]) > best[at]
            at, pos = at[better], pos[better]
            best[at], score[at] = np.abs(self.z[pos]), self.odds[pos]
        return score - DRIFT

    def evidence(self, segments: list[float], n: int) -> float:
        base = self.log_k + math.log(max(n, 1))
        return sum(max(0.0, self.lam * s - base) for s in segments)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: runs of
    tokens of one sign are joined first, then each positive run either opens a
    segment or is merged with those it lets grow."""
    if not len(scores) or not (scores > 0).any():
        return []
    up = scores > 0
    cut = np.concatenate(([0], np.flatnonzero(up[1:] != up[:-1]) + 1, [len(scores)]))
    sums = np.add.reduceat(scores, cut[:-1])
    stack: list[list] = []         # start, end, sum before, sum through
    total = 0.0
    for i, s in enumerate(sums.tolist()):
        if s <= 0:
            total += s
            continue
        new = [int(cut[i]), int(cut[i + 1]), total, total + s]
        total += s
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(a, b, r - left) for a, b, left, r in stack]


def _scored(model, batch):
    """(row, tokens, segments, token scores) of every text of an Arrow batch."""
    if not hasattr(model, "seen"):
        model.prepare()
    for lo, hi, data, offs in kernel.blocks(batch.column("text")):
        doc, features = _features(data, offs)
        scores = model.token_scores(features)
        cut = kernel.bounds(doc, hi - lo)
        hot = np.zeros(hi - lo, bool)
        hot[doc[scores > 0]] = True
        for d in range(hi - lo):
            own = scores[cut[d]:cut[d + 1]]
            yield lo + d, len(own), maximal_segments(own) if hot[d] else [], own


def _background(shared):
    """Histogram of clean token scores (kind 0) and of clean segments (kind 1)."""
    def run(batches):
        model = shared.value
        for batch in batches:
            clean = [t == 0 for t in batch.column("toxic").to_pylist()]
            tokens, segments = [], []
            for row, _, found, own in _scored(model, batch):
                if clean[row]:
                    tokens.append(own)
                    segments += [s for _, _, s in found]
            for kind, values in ((0, np.concatenate(tokens) if tokens else np.zeros(0)), (1, np.array(segments))):
                bins, counts = np.unique(np.floor(values / BIN).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), kind)), pa.array(bins), pa.array(counts)],
                                                 ["kind", "bin", "n"])
    return run


def _evidence(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            rows = [(model.evidence([s for _, _, s in found], n), n, len(found)) for _, n, found, _ in _scored(model, batch)]
            x, n, k = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic") if "toxic" in batch.schema.names else pa.nulls(len(batch), pa.int32()),
                 pa.array(x, pa.float64()), pa.array(n, pa.int64()), pa.array(k, pa.int64())],
                ["doc_id", "toxic", "evidence", "n_tokens", "n_segments"])
    return run


def _solve_lambda(score: np.ndarray, n: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 if no positive score is seen."""
    if not (score > 0).any() or (score * n).sum() >= 0:
        return 1.0
    p, lo, hi = n / n.sum(), 0.0, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.clip(mid * score, -700, 700))).sum() < 1 else (lo, mid)
    return lo


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Ridge-damped Newton fit of a one-variable logistic curve on a histogram."""
    share = (n * y).sum() / n.sum()
    w = np.array([math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0])
    a = np.stack([np.ones_like(x), x], 1)

    def loss(v):
        t = a @ v
        return (n * (np.logaddexp(0, t) - y * t)).sum() + 5e-3 * v @ v

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (p - y)) + 1e-2 * w
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step, now = np.linalg.solve(hess, grad), loss(w)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
    return float(w[0]), float(max(w[1], 0.0))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic. All rows given are learnt
    from, up to ``train_rows`` documents."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    train = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    counts = train.mapInArrow(_count, "feature long, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts.where("toxic + clean > 2 OR feature = 0"), "toxicity-counts")
    totals = counts.where("feature = 0").collect()
    n_t, n_c = (float(totals[0].toxic), float(totals[0].clean)) if totals else (0.0, 0.0)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if not n_t or not n_c:
        seen = train.select("toxic").groupBy("toxic").count().collect()
        total, toxic = sum(r["count"] for r in seen), sum(r["count"] for r in seen if r.toxic)
        none.base = math.log((toxic + 0.5) / (total - toxic + 0.5))
        return none
    prior = PRIOR_SHARE * (n_t + n_c)
    alpha = (F.col("toxic") + F.col("clean")) * PRIOR_SHARE
    odds = (F.log((F.col("toxic") + alpha) / (n_t + prior - F.col("toxic") - alpha))
            - F.log((F.col("clean") + alpha) / (n_c + prior - F.col("clean") - alpha)))
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    model = counts.where("feature <> 0").select("feature", odds.alias("odds"), (odds / spread).alias("z"))
    model = model.where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "feature").limit(MAX_FEATURES)
    rows = model.collect()         # at most MAX_FEATURES small rows
    keys = np.array([r.feature for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    m = Model(keys[order], np.array([r.odds for r in rows])[order], np.array([r.z for r in rows])[order])
    if not len(keys):
        m = Model(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1))
    sc = spark.sparkContext
    hist = train.mapInArrow(_background(sc.broadcast(m)), "kind long, bin long, n long").groupBy("kind", "bin").agg(
        F.sum("n").alias("n")).collect()          # as many rows as bins of scores
    score = np.array([(r.bin + 0.5) * BIN for r in hist if r.kind == 0])
    n = np.array([r.n for r in hist if r.kind == 0], float)
    m.lam = _solve_lambda(score, n)
    segments = sum(r.n for r in hist if r.kind == 1 and r.bin * BIN >= 1)
    m.log_k = m.lam + math.log((segments + 0.5) / max(n.sum(), 1))
    seen = train.mapInArrow(_evidence(sc.broadcast(m)), "doc_id long, toxic int, evidence double, n_tokens long, n_segments long")
    bins = seen.groupBy(F.least(F.floor(F.col("evidence") / BIN), F.lit(2000)).alias("bin"), (F.col("toxic") > 0).alias("y")).agg(
        F.count("*").alias("n")).collect()        # at most 2,001 bins for each class
    x = np.log1p([r.bin * BIN for r in bins])
    m.base, m.slope = _logistic(x, np.array([float(r.y) for r in bins]), np.array([float(r.n) for r in bins]))
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence, tokens and segments of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    if not len(model.keys):
        model = Model(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1), base=model.base)
    found = id_text(docs).mapInArrow(_evidence(spark.sparkContext.broadcast(model)),
                                     "doc_id long, toxic int, evidence double, n_tokens long, n_segments long")
    p = 1 / (1 + F.exp(-(F.lit(model.base) + F.lit(model.slope) * F.log1p("evidence"))))
    return found.select("doc_id", p.alias("score"), "evidence", "n_tokens", "n_segments")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, score, expected) of every segment, in words;
    ``expected`` is the number of such segments by chance in a clean text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[row], a, b, s, math.exp(min(700.0, m.log_k + math.log(n) - m.lam * s)))
                    for row, n, found, _ in _scored(m, batch) for a, b, s in found]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["doc_id", "start", "end", "score", "expected"])
    return id_text(docs).mapInArrow(run, "doc_id long, start long, end long, score double, expected double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)
    scored = score(docs, learn(docs, labels))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         "evidence", "n_tokens", "n_segments")

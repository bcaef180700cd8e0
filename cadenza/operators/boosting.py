"""Gradient boosting over shared histograms.

All classes' trees of a round grow together: features are cut into at most
``max_bins`` codes once, and each level of a round is one pass over the coded
rows that sums gradient, curvature or count (:func:`summed`) by (class, node, feature, bin) inside
every partition; of two children only the smaller one is summed where the other is the parent's
remainder. The partial histograms, of a size that depends on the trees and
not on the rows, are added up (in a tree of tasks where there are many
partitions), and the driver picks the splits from them. Two kinds:

* ``first``: trees fitted to the residuals by their squared error, leaves by one
  Newton step of the softmax loss, ``(K - 1) / K sum(r) / sum(|r| (1 - |r|))``;
* ``second``: gain and leaf value from gradient and curvature sums with an L2
  penalty, ``G^2 / (H + l2)`` and ``-G / (H + l2)``.

This needs state per partition (the current margins) and whole-array sums, which
DataFrame functions can't express, hence one RDD of coded blocks. Every ``CARRY`` rounds the
blocks are written anew with their margins, so that no task has more than the trees since then to
add, wherever it runs. Besides, a worker keeps some blocks' margins, gradients and nodes between
passes; they are a function of the trees alone, as is all that a lost executor held.

Edge cases: NULL and NaN features fall in the last bin. One class, or no row that
can be split, gives trees of one leaf.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize, ship_package, work_dir

BLOCK_ROWS = 1 << 15
TASK_ROWS = 16384             # at least, of a partition
TREE_AT = 64                 # partitions from which partial histograms are added up in tasks first
KEPT = 32                    # blocks whose margins, gradients and nodes a worker keeps
ALONE_ROWS = 1 << 19         # rows (and a third of rows by class) up to which one task grows all rounds: a pass would cost more to start
CARRY = 2                    # rounds between writings of the margins
LINEAGE = 50                 # writings after which one goes to the checkpoint folder
_MARGINS: dict[tuple, tuple] = {}


@dataclass
class Boosting:
    """Estimator: ``classes`` > 0 for softmax over label codes 0.., 0 for squared error."""
    features: list[str]
    label: str
    classes: int = 0
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    kind: str = "first"
    l2: float = 1.0
    min_curvature: float = 1.0          # of a child, second order only
    max_bins: int = 32

    def fit(self, train: DataFrame) -> BoostedModel:
        return _fit(self, train)


@dataclass
class BoostedModel:
    """``trees[round][class]`` = (feature, bin, value) arrays in heap order from 1; feature -1 is a leaf."""
    features: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[list[tuple]]
    classes: int

    def margins(self, codes: np.ndarray) -> np.ndarray:
        return _add_trees(np.tile(self.base, (len(codes), 1)), codes, self.trees)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the predicted label code (the smallest of equal ones) or value."""
        ship_package(df.sparkSession)
        edges, model = self.edges, self

        @F.pandas_udf("double")
        def predict(frame):
            import pandas as pd

            m = model.margins(_coded(frame.to_numpy(np.float64), edges))
            return pd.Series(m.argmax(1).astype(float) if model.classes else m[:, 0])

        return df.withColumn(out, predict(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])))


def bin_edges(train: DataFrame, features: list[str], max_bins: int) -> list[np.ndarray]:
    """Up to ``max_bins`` - 1 different quantiles of each feature, in one pass; a
    feature of few values has one after each of them, so bins split between all."""
    probs = [i / max_bins for i in range(1, max_bins)]
    row = train.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in row]


def _coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of edges below each value: code b or less is a value of edge b or less."""
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8) if edges else np.zeros((len(x), 0), np.uint8)


def _coder(edges: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(edges))], 1) if edges else np.zeros((len(batch), 0))
            raw = _coded(x, edges).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i * len(edges):(i + 1) * len(edges)] for i in range(len(batch))], pa.binary()),
                                              batch.column("y")], ["codes", "y"])
    return run


def _completed(tree: tuple) -> tuple:
    """Arrays (feature, cut, value) of a tree in which every row takes every step: below a leaf
    all rows go left, and leaves pass their value down."""
    feature, cut, value = (a.copy() for a in tree)
    cut[feature < 0] = 255
    value = np.array(value, np.float64)
    for level in range(len(feature).bit_length() - 2):
        node = np.arange(1 << level, 2 << level)
        leaf = node[feature[node] < 0]
        value[2 * leaf] = value[2 * leaf + 1] = value[leaf]
    return np.maximum(feature, 0), cut, value


def _steps(node: np.ndarray, codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The nodes ``levels`` steps further, of a completed tree."""
    flat, rows, at = codes.T.reshape(-1), np.arange(len(codes)), feature.astype(np.int64) * len(codes)
    for _ in range(levels):
        node = 2 * node + (flat.take(at.take(node) + rows) > cut.take(node))
    return node


def _add_trees(margins: np.ndarray, codes: np.ndarray, trees: list[list[tuple]]) -> np.ndarray:
    codes = np.asfortranarray(codes)
    for of_round in trees:
        for k, tree in enumerate(of_round):
            feature, cut, value = _completed(tree)
            margins[:, k] += value.take(_steps(np.ones(len(codes), np.int64), codes, feature, cut, len(feature).bit_length() - 2))
    return margins


def gradients(margins: np.ndarray, y: np.ndarray, classes: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss by row and class."""
    if not classes:
        return margins - y[:, None], np.ones_like(margins)
    m = np.ascontiguousarray(margins.T)          # a class's rows side by side
    e = np.exp(m - m.max(0))
    p = e / e.sum(0)
    g = p.copy()
    g[y.astype(np.int64), np.arange(len(y))] -= 1
    return g.T, (np.abs(g) * (1 - np.abs(g)) if kind == "first" else np.maximum(2 * p * (1 - p), 1e-16)).T


def _blocks(rows):
    """(codes, labels) arrays of a partition."""
    rows = iter(rows)
    while part := list(islice(rows, BLOCK_ROWS)):
        codes = np.frombuffer(b"".join(bytes(r[0]) for r in part), np.uint8).reshape(len(part), -1)
        yield np.asfortranarray(codes), np.array([r[1] for r in part])


def summed(est: Boosting) -> list[str]:
    """What is summed: gradient, curvature, count. The curvature of squared error is the count; a
    curvature minimum above 0 tells empty children without the count."""
    if not est.classes:
        return ["g", "n"]
    return ["g", "h"] if est.kind == "second" and est.min_curvature > 0 else ["g", "h", "n"]


def _by_remainder(est: Boosting) -> bool:
    """If a child may be had as its parent less its sibling. Newton leaves without a penalty divide
    sums that may be far smaller than the parent's, and so are summed themselves."""
    return not (est.kind == "first" and est.classes)


def _margins_of(block: tuple, kept: tuple | None, base: np.ndarray, recent: list, since: int) -> tuple[np.ndarray, bool]:
    """The block's margins after ``since`` trees and ``recent`` ones, and if they are those kept; a block has those of ``since``."""
    done, margins = kept[:2] if kept and kept[0] >= since else (since, None)
    if margins is None:
        margins = np.array(block[2]) if len(block) > 2 else np.tile(base, (len(block[0]), 1))
        kept = None
    if done < since + len(recent):
        return _add_trees(margins, block[0], recent[done - since:]), False
    return margins, kept is not None


def _state_of(run: str, index: int, number: int, block: tuple, base: np.ndarray, recent: list, since: int, growing: list, level: int,
              est: Boosting) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The block's gradients and curvatures, by class, and each class's node of every row at ``level`` of
    the trees that grow: from what this worker keeps, or what the block has, and what is new since."""
    key, codes = (run, index, number), block[0]
    kept = _MARGINS.pop(key, None)
    margins, same = _margins_of(block, kept, base, recent, since)
    slopes, at, nodes = kept[2:] if same else (None, 0, None)
    if slopes is None:
        slopes = [np.ascontiguousarray(a.T) for a in gradients(margins, block[1], est.classes, est.kind)]
    if nodes is None or at > level:
        at, nodes = 0, [np.ones(len(codes), np.int64) for _ in growing]
    if at < level:
        nodes = [_steps(node, codes, *_completed(tree)[:2], level - at) for node, tree in zip(nodes, growing)]
    if len(_MARGINS) >= KEPT:                # boosters that grow side by side share a worker as long as there is room
        for old in [x for x in _MARGINS if x[0] != run]:
            _MARGINS.pop(old, None)
    if len(_MARGINS) < KEPT:                 # the first stay: each would be gone before its turn if the last did
        _MARGINS[key] = (since + len(recent), margins, slopes, level, nodes)
    return *slopes, nodes


def _carry(run: str, base, recent: list, since: int, index: int, blocks):
    """The blocks with their margins after the trees so far."""
    for b, block in enumerate(blocks):
        yield block[0], block[1], _margins_of(block, None, base, recent, since)[0]


def _cells(codes: np.ndarray, use: np.ndarray | None, at: np.ndarray, weights: list, nodes: int, bins: int, out: np.ndarray) -> None:
    """Adds to ``out`` (statistic, node, feature, bin) the ``weights`` (None: 1) of the rows ``use`` (None: all) at the
    nodes ``at``: two features at a time where their common cells are few for the rows, else one."""
    width = codes.shape[1]
    step = 2 if nodes * bins * bins <= len(at) // 2 else 1
    for f in range(0, width, step):
        two = step == 2 and f + 1 < width
        code = codes[:, f]
        if two:
            code = code.astype(np.uint16) * np.uint16(bins) + codes[:, f + 1]
        size = bins * bins if two else bins
        cell = at * size + (code if use is None else code.take(use))
        for i, w in enumerate(weights):
            found = np.bincount(cell, w, nodes * size)[:nodes * size]
            if two:
                found = found.reshape(nodes, bins, bins)
                out[i, :nodes, f] += found.sum(2)
                out[i, :nodes, f + 1] += found.sum(1)
            else:
                out[i, :nodes, f] += found.reshape(nodes, bins)


def _histograms(run: str, base, recent: list, since: int, growing: list, built: list, level: int, est: Boosting, bins: int, index: int,
                blocks) -> list[np.ndarray]:
    """Of one partition: the sums by class, node of ``built``, feature and bin. A function of the module, not a
    closure, so that workers share what they keep."""
    first, names = 1 << level, summed(est)
    total, any_row = np.zeros((len(growing), len(names), max(map(len, built)), len(est.features), bins)), False
    places = []
    for nodes in built:
        places.append(np.full(first, -1))
        places[-1][nodes] = np.arange(len(nodes))
    for b, block in enumerate(blocks):
        any_row = True
        g, h, nodes = _state_of(run, index, b, block, base, recent, since, growing, level, est)
        for c, place in enumerate(places):
            if not len(built[c]):
                continue
            weights, use = [{"g": g[c], "h": h[c], "n": None}[n] for n in names], None
            if level:
                at = place.take(nodes[c] - first)
                use = np.flatnonzero(at >= 0)
                if len(use) == len(at):
                    use = None
                else:
                    at, weights = at.take(use), [w if w is None else w.take(use) for w in weights]
            else:
                at = np.zeros(len(block[0]), np.int64)
            _cells(block[0], use, at, weights, len(built[c]), bins, total[c])
    return [total] if any_row else []


def best_splits(sums: np.ndarray, est: Boosting) -> tuple:
    """Of (gradient, curvature, count) by (node, feature, bin): for every node the
    feature, the bin, the gain and both children's sums; ties to the first feature and bin."""
    left = sums.cumsum(3)
    whole = left[:, :, :1, -1:]
    right = whole - left
    weigh = (lambda s: np.where(s[2] > 0, s[0] ** 2 / np.maximum(s[2], 1), 0.0)) if est.kind == "first" else (lambda s: s[0] ** 2 / (s[1] + est.l2))
    gain = weigh(left) + weigh(right) - weigh(whole)
    allowed = (left[2] > 0) & (right[2] > 0)
    if est.kind == "second":
        allowed &= (left[1] >= est.min_curvature) & (right[1] >= est.min_curvature)
    gain = np.where(allowed, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    # equal gains of different cuts differ by rounding only: the first of them is taken
    top = flat.max(1, keepdims=True)
    best = (flat >= top - 1e-9 * np.maximum(1, np.abs(top))).argmax(1)
    f, b = np.unravel_index(best, gain.shape[1:])
    at = np.arange(len(gain))
    return f, b, flat[at, best], left[:, at, f, b], right[:, at, f, b]


def leaf_value(g: np.ndarray, h: np.ndarray, est: Boosting) -> np.ndarray:
    if est.kind == "second" or not est.classes:
        return -g / (h + (est.l2 if est.kind == "second" else 0.0) + 1e-300)
    return np.where(np.abs(h) < 1e-150, 0.0, -g * (est.classes - 1) / est.classes / np.where(np.abs(h) < 1e-150, 1.0, h))


def _fit(est: Boosting, train: DataFrame) -> BoostedModel:
    spark = train.sparkSession
    ship_package(spark)
    edges = bin_edges(train, est.features, est.max_bins)
    bins, k = max([len(e) for e in edges], default=0) + 1, max(1, est.classes)

    columns = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(est.features)] + [F.col(est.label).cast("double").alias("y")]
    coded = materialize(train.select(*columns).mapInArrow(_coder(edges), "codes binary, y double"), "boosting-codes")
    rows = coded.count()
    if est.classes:
        n = np.zeros(k)
        for r in coded.groupBy("y").count().collect():        # one row a class
            n[int(r.y)] = r["count"]
        base = np.log(np.maximum(n, 1e-9) / max(n.sum(), 1))
    else:
        base = np.array([coded.agg(F.avg("y")).first()[0] or 0.0])
    if rows <= ALONE_ROWS and rows * k * (1 if _by_remainder(est) else 2) <= 3 * ALONE_ROWS:
        grown = coded.coalesce(1).rdd.mapPartitions(_blocks).mapPartitions(partial(_grow_alone, est, base, bins, k)).collect()
        return BoostedModel(est.features, edges, base, grown[0] if grown else list(_grow_alone(est, base, bins, k, []))[0], est.classes)
    # a pass is short: tasks of too few rows would cost more to start than to run
    data = coded.coalesce(max(1, -(-rows // TASK_ROWS))).rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)
    parts, run, trees = data.getNumPartitions(), uuid.uuid4().hex, []
    since, before = 0, None
    try:
        for done in range(1, est.rounds + 1):
            trees.append(_grow(est, data, parts, run, base, trees, bins, k, since))
            if before is not None:               # the pass has read all that the blocks were written from
                before.unpersist()
                before = None
            if not done % CARRY and done < est.rounds:
                before, data = data, data.mapPartitionsWithIndex(partial(_carry, run, base, trees[since:], since)).persist(StorageLevel.MEMORY_AND_DISK)
                since = done
                if not done % (CARRY * LINEAGE):
                    work_dir(spark)
                    data.checkpoint()            # else the plan of every task would grow with the rounds
    finally:
        data.unpersist()
        if before is not None:
            before.unpersist()
    return BoostedModel(est.features, edges, base, trees, est.classes)


class _Here:
    """Blocks of a task in the place of an RDD of one partition."""

    def __init__(self, blocks):
        self.blocks = list(blocks)

    def mapPartitionsWithIndex(self, run):
        self.run = run
        return self

    def collect(self) -> list:
        return self.run(0, iter(self.blocks))


def _grow_alone(est: Boosting, base, bins: int, k: int, blocks):
    """All rounds in one task, the passes over its own blocks."""
    data, run, trees = _Here(blocks), uuid.uuid4().hex, []
    for _ in range(est.rounds):
        trees.append(_grow(est, data, 1, run, base, trees, bins, k))
    for key in [x for x in _MARGINS if x[0] == run]:
        _MARGINS.pop(key)
    yield trees


def _grow(est: Boosting, data, parts: int, run: str, base, trees, bins: int, k: int, since: int = 0) -> list[tuple]:
    """The trees of one round, a pass a level. ``data`` has the margins after ``since`` rounds."""
    size, width, names = 2 << est.depth, len(est.features), summed(est)
    growing = [(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(k)]
    built, parents = [np.zeros(1, np.int64) for _ in range(k)], [None] * k
    for level in range(est.depth):
        found = data.mapPartitionsWithIndex(partial(_histograms, run, base, trees[since:], since, growing, built, level, est, bins))
        if parts > TREE_AT:
            total = found.treeReduce(np.add, max(2, round(np.log(parts) / np.log(TREE_AT)) + 1))
        else:
            found = found.collect()              # at most TREE_AT arrays of one size
            total = sum(found[1:], found[0]) if found else None
        if total is None:
            break
        first = 1 << level
        for c, (feature, cut, value) in enumerate(growing):
            sums = np.zeros((len(names), first, width, bins))
            sums[:, built[c]] = total[c, :, :len(built[c])]
            if level and _by_remainder(est):
                sums[:, built[c] ^ 1] = parents[c][:, built[c] >> 1] - sums[:, built[c]]
            parents[c] = sums
            of = dict(zip(names, sums))
            sums = np.stack([of["g"], of.get("h", of.get("n")), of.get("n", of.get("h"))])
            f, b, gain, left, right = best_splits(sums, est)
            node = first + np.arange(first)
            if not level:
                g, h, _ = sums[:, 0, 0].sum(1)
                value[1] = leaf_value(g, h, est)
            split = np.isfinite(gain) & (gain > 1e-9) & ((feature[node >> 1] >= 0) if level else True)
            feature[node[split]], cut[node[split]] = f[split], b[split]
            value[2 * node[split]] = leaf_value(left[0, split], left[1, split], est)
            value[2 * node[split] + 1] = leaf_value(right[0, split], right[1, split], est)
            at = np.flatnonzero(split)
            built[c] = np.sort(2 * at + (right[2, at] < left[2, at])) if _by_remainder(est) else np.sort(np.concatenate([2 * at, 2 * at + 1]))
        if not any(map(len, built)):
            break
    return [(f, b, est.rate * v) for f, b, v in growing]

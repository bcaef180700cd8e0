"""Progressive centroid search against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from cadenza.llm import op12_centroids as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        a = assign()
        for c in range(len(cents)):
            own = [v for (x, _), (_, v) in zip(a, kept) if x == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    a = assign()
    total = sum(d for _, d in a)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i if i is not None else -1), c, d, sum(y for x, y in a if x == c), total, sha[c]) for (i, _), (c, d) in zip(kept, a))


def result(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    f = lambda x: float(np.float32(x))
    centres = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(6)]
    out = [(i, [f(c + rng.gauss(0, 0.1)) for c in rng.choice(centres)], 0) for i in range(300)]
    out += [(1000 + i, [f(0.5)] * 64, 0) for i in range(150)]                   # a third are one vector
    out += [(7, out[7][1], 0), (7, out[7][1], 0), (None, out[9][1], 0), (None, [f(-0.001)] * 64, 1)]
    bad = [None, [], [0.1] * 63, [0.1] * 65, [0.1] * 63 + [None], [0.1] * 63 + [float("nan")], [0.1] * 63 + [float("inf")]]
    return out + [(2000 + i, v, 0) for i, v in enumerate(bad)]


def test_clusters(spark, rows):
    got = result(op.report(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == brute(rows) and len({r[1] for r in got}) > 5


def test_few_large_and_no_vectors(spark):
    rows = [(i, [float((i * 37 + j * 11) % 7 - 3) * 50_000 for j in range(64)], 0) for i in range(9)]
    assert result(op.report(spark.createDataFrame(rows, SCHEMA), rounds=2)) == brute(rows, rounds=2)
    assert op.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.report(spark.createDataFrame([(1, None, 2)], SCHEMA)).collect() == []


def test_transform_keeps_distances_and_search_is_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-300, 300, (200, 64)), rng.integers(-300, 300, (17, 64))
    c[5] = c[3]                                                              # a tie
    t = op.transform(x)
    assert ((t ** 2).sum(1) == 64 * (x ** 2).sum(1)).all() and (t[:, 0] == x.sum(1)).all()
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    for scale in (1, 1 << 20):                                               # the second through whole numbers of any size
        cluster, distance = op.nearest(x * scale, c * scale)
        assert (cluster == d.argmin(1)).all() and [int(v) for v in distance] == [int(v) * scale * scale for v in d.min(1)]
    assert not (cluster == 5).any()

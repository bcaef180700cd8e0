"""Shared-histogram boosting against brute force on a small table."""

import numpy as np
import pytest

from cadenza.operators.boosting import Boosting, gradients


def brute(x, y, classes, rounds, depth, rate, kind, l2=1.0, min_h=1.0):
    """The same trees by trying every cut of every node on the raw values."""
    k = max(1, classes)
    margins = np.tile(np.log(np.bincount(y.astype(int), minlength=k) / len(y)) if classes else [y.mean()], (len(y), 1)).astype(float)

    def leaf(g, h):
        if kind == "second" or not classes:
            return -g.sum() / (h.sum() + (l2 if kind == "second" else 0))
        return 0.0 if h.sum() < 1e-150 else -g.sum() / h.sum() * (classes - 1) / classes

    def weigh(g, h):
        return g.sum() ** 2 / (len(g) if kind == "first" else h.sum() + l2)

    def grow(rows, g, h, left_levels, out):
        best = None
        if left_levels:
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f])[:-1]:
                    lo, hi = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                    if kind == "second" and min(h[lo].sum(), h[hi].sum()) < min_h:
                        continue
                    gain = weigh(g[lo], h[lo]) + weigh(g[hi], h[hi]) - weigh(g[rows], h[rows])
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9 * max(1, abs(best[0]))):
                        best = (gain, lo, hi)
        if best is None:
            out[rows] = leaf(g[rows], h[rows])
        else:
            grow(best[1], g, h, left_levels - 1, out)
            grow(best[2], g, h, left_levels - 1, out)

    for _ in range(rounds):
        g, h = gradients(margins, y, classes, kind)
        step = np.zeros_like(margins)
        for c in range(k):
            grow(np.arange(len(y)), g[:, c], h[:, c], depth, step[:, c])
        margins += rate * step
    return margins


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (240, 3)).astype(float)
    x[:, 2] = rng.integers(0, 2, 240)
    score = x[:, 0] * 1.5 - x[:, 1] + 3 * x[:, 2] + rng.normal(0, 1, 240)
    return x, np.digitize(score, [-3, 2, 7]).astype(float), score


@pytest.mark.parametrize("kind,classes,depth", [("first", 4, 3), ("second", 4, 3), ("second", 0, 2), ("first", 0, 2)])
def test_equal_to_brute_force(spark, table, kind, classes, depth):
    x, codes, score = table
    y = codes if classes else score
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i long, a double, b double, c double, y double")
    model = Boosting(["a", "b", "c"], "y", classes, rounds=4, depth=depth, rate=0.3, kind=kind).fit(df.repartition(3))
    want = brute(x, y, classes, 4, depth, 0.3, kind)
    got = {r.i: r.prediction for r in model.transform(df).select("i", "prediction").collect()}
    want = want.argmax(1) if classes else want[:, 0]
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-6)


def test_first_leaf_is_the_closed_form(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0), (2.0, 9.0), (None, 11.0)], "a double, y double")
    model = Boosting(["a"], "y", rounds=1, depth=1, rate=1.0, kind="second", l2=2.0).fit(df)
    feature, cut, value = model.trees[0][0]
    assert feature[1] == 0 and model.base[0] == 7.0
    # mean 7; gradients 4 and 2 to the left, -2 and -4 to the right; two rows a leaf
    assert np.allclose(value[2:4], [-6 / 4, 6 / 4])


def test_constant_features_and_one_class(spark):
    df = spark.createDataFrame([(1.0, 0.0)] * 6, "a double, y double")
    for classes in (0, 1, 3):
        model = Boosting(["a"], "y", classes, rounds=2).fit(df)
        assert {r.prediction for r in model.transform(df).collect()} == {0.0}


def test_kept_state_serves_a_whole_round(monkeypatch):
    """Gradients are computed once a round, not once a level, and a worker that kept nothing gets the same trees."""
    import numpy as np

    from cadenza.operators import boosting

    rng = np.random.default_rng(0)
    blocks = [(rng.integers(0, 8, (500, 3)).astype(np.uint8), rng.integers(0, 3, 500).astype(float)) for _ in range(2)]
    calls, whole = [], boosting.gradients
    monkeypatch.setattr(boosting, "gradients", lambda *a: calls.append(1) or whole(*a))

    class Data:
        forget = False

        def mapPartitionsWithIndex(self, run):
            self.run = run
            return self

        def collect(self):
            if self.forget:
                boosting._MARGINS.clear()
            return self.run(0, iter(blocks))

    est = boosting.Boosting(["a", "b", "c"], "y", 3, 2, 4, 0.1, "second")
    grown = []
    for name in ("kept", "lost"):
        data, trees = Data(), []
        data.forget = name == "lost"
        for _ in range(2):
            trees.append(boosting._grow(est, data, 1, name, np.zeros(3), trees, 8, 3))
        grown.append(trees)
        if name == "kept":
            assert len(calls) == 2 * len(blocks)
    assert all((a == b).all() for x, y in zip(*grown) for p, q in zip(x, y) for a, b in zip(p, q))


def test_a_task_that_kept_nothing_adds_a_few_rounds_only(spark, table, monkeypatch):
    """Blocks are written anew with their margins, so work doesn't grow with the rounds; the trees are the same."""
    from cadenza.operators import boosting

    x, codes, _ = table
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, codes)], "a double, b double, c double, y double").repartition(3)
    grown, sinces = [], []
    whole = boosting._grow

    def noted(est, data, parts, run, base, trees, bins, k, since=0):
        sinces.append(len(trees) - since)
        return whole(est, data, parts, run, base, trees, bins, k, since)
    grown.append(Boosting(["a", "b", "c"], "y", 4, rounds=7, depth=3, rate=0.3, kind="second").fit(df).trees)     # in one task
    monkeypatch.setattr(boosting, "_grow", noted)
    monkeypatch.setattr(boosting, "ALONE_ROWS", 0)
    for carry, lineage in ((2, 50), (1000, 50), (1, 2)):
        monkeypatch.setattr(boosting, "CARRY", carry)
        monkeypatch.setattr(boosting, "LINEAGE", lineage)
        grown.append(Boosting(["a", "b", "c"], "y", 4, rounds=7, depth=3, rate=0.3, kind="second").fit(df).trees)
    assert max(sinces[:7]) < 2 and max(sinces[7:14]) == 6 and max(sinces[14:]) == 0
    for other in grown[1:]:
        assert all(np.allclose(a, b) for r, s in zip(grown[0], other) for p, q in zip(r, s) for a, b in zip(p, q))


def test_sums_of_pairs_of_features_and_of_remainders():
    """Cells of two features at a time, of one, and of chosen rows are the plain sums; sibling = parent - child."""
    from cadenza.operators import boosting

    rng = np.random.default_rng(3)
    codes = np.asfortranarray(rng.integers(0, 5, (4000, 5)).astype(np.uint8))
    at, g = rng.integers(0, 3, 4000), rng.normal(size=4000)
    for use in (None, np.flatnonzero(rng.random(4000) < 0.3), np.arange(40)):
        rows = np.arange(4000) if use is None else use
        out = np.zeros((2, 3, 5, 5))
        boosting._cells(codes, use, at[rows], [g[rows], None], 3, 5, out)
        for node in range(3):
            for f in range(5):
                for v in range(5):
                    hit = (at[rows] == node) & (codes[rows, f] == v)
                    assert out[1, node, f, v] == hit.sum() and abs(out[0, node, f, v] - g[rows][hit].sum()) < 1e-9


def test_squared_error_booster_of_the_regressors(spark, table, monkeypatch):
    """The registered booster starts at the mean and grows by shared histograms, without Spark's learner."""
    from pyspark.ml.regression import GBTRegressor

    from cadenza.operators import model

    x, _, score = table
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, score))], "i long, a double, b double, c double, popularity double")
    est = model.regressors(240, 1.0, sizes=model.Sizes(boost_rounds=4))["Gradient Boosting"]

    def no(*a):
        raise AssertionError("Spark's learner was called")
    monkeypatch.setattr(GBTRegressor, "fit", no)
    got = model.fit_one(est, df, {}, ["a", "b", "c"]).transform(df).orderBy("i").toPandas()
    assert np.allclose(got.prediction, brute(x, score, 0, 4, 3, 0.1, "first")[:, 0], atol=1e-6)


def test_models_are_fitted_side_by_side_in_their_order(spark, monkeypatch):
    import threading

    from cadenza.operators import model

    together = threading.Barrier(3, timeout=60)      # passes only if three fits run at once

    def fit(est, train, stats, feats):
        if est < 4:
            together.wait()
        return est * 10
    monkeypatch.setattr(model, "fit_one", fit)
    df = spark.range(1)
    assert list(model.fit_all({"a": 4, "b": 3, "c": 2, "d": 1}, df, {}, []).items()) == [("a", 40), ("b", 30), ("c", 20), ("d", 10)]
    assert model.fit_all({"a": 4}, df, {}, []) == {"a": 40} and model.fit_all({}, df, {}, []) == {}


def test_few_rows_are_grown_in_one_task(spark, table, monkeypatch):
    """No pass over an RDD by the driver, and none at all for no rows."""
    from cadenza.operators import boosting

    x, _, score = table
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, score)], "a double, b double, c double, y double").repartition(3)
    both = []
    for rows in (0, 1 << 19):
        monkeypatch.setattr(boosting, "ALONE_ROWS", rows)
        if rows:
            monkeypatch.setattr(boosting, "_carry", None)
        both.append(Boosting(["a", "b", "c"], "y", rounds=5, depth=3, rate=0.3).fit(df))
    assert all(np.allclose(a, b) for r, s in zip(both[0].trees, both[1].trees) for p, q in zip(r, s) for a, b in zip(p, q))
    none = Boosting(["a", "b", "c"], "y", rounds=2).fit(df.where("a < -1"))
    assert len(none.trees) == 2 and none.transform(df).first()["prediction"] == 0.0

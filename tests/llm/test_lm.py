"""The class bigram model against brute force on a small table."""

import collections
import math
import random

import numpy as np
import pytest


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # two kinds of words that follow each other, more of them than 2,048, and words too rare to be units
    first, second = [f"a{i}x" for i in range(1500)], [f"b{i}y" for i in range(1500)]
    out = []
    for d in range(700):
        text = [rng.choice((first, second)[j % 2]) for j in range(60)]
        text[7:7] = [f"rare{rng.randrange(4000)}"]
        out.append((d, " ".join(text)))
    return out + [(9001, None), (9002, "never seen a1x"), (9003, "")]


def scores(spark, rows, monkeypatch, cached):
    from cadenza.llm import op2_lm
    monkeypatch.setattr(op2_lm, "CACHED", cached)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, counts, words = op2_lm.learn(docs.where("doc_id < 9000"))
    return model, {r.doc_id: r for r in op2_lm.score(docs, model, counts, words).collect()}, {r.h: r.number for r in words.collect()}


def test_every_word_above_the_minimum_is_clustered(spark, rows, monkeypatch):
    from cadenza.llm import kernel, op2_lm
    model, got, number = scores(spark, rows, monkeypatch, 1 << 18)
    count = collections.Counter(w for d, t in rows if d < 9000 for w in t.split())
    units = [w for w, c in count.items() if c >= op2_lm.MIN_COUNT]
    assert model.n_words == len(units) > 2048 and len(model.classes) == len(units) + op2_lm.TAILS + 1
    data = {w: np.frombuffer(w.encode(), np.uint8) for w in [*count, "never", "seen"]}
    span = {w: kernel.span_hash(x, np.array([0]), np.array([len(x)]))[0] for w, x in data.items()}
    tail = {w: int(kernel.span_hash(x, np.array([len(x) - 2]), np.array([len(x)]))[0] % np.uint64(op2_lm.TAILS)) for w, x in data.items()}
    unit = {w: number[int(span[w].view(np.int64))] if count[w] >= op2_lm.MIN_COUNT else len(units) + tail[w] for w in data}
    # the two kinds of words end up in different classes
    kinds = [{int(model.classes[unit[w]]) for w in units if w[0] == k} for k in "ab"]
    both = kinds[0] & kinds[1]
    assert sum(int(model.classes[unit[w]]) in both for w in units) < 0.05 * len(units)
    # class pairs and scores, counted again
    end = len(units) + op2_lm.TAILS
    table, uc, tv = np.zeros((op2_lm.CLASSES,) * 2), collections.Counter(), collections.Counter()
    for d, t in rows:
        if d < 9000:
            seq = [end, *[unit[w] for w in t.split()], end]
            uc.update(seq[1:])
            for u, v in zip(seq, seq[1:], strict=False):
                table[model.classes[u], model.classes[v]] += 1
    tv.update(unit[w] for w in count if unit[w] >= len(units))
    size, mass = np.bincount(model.classes, minlength=op2_lm.CLASSES), table.sum(0)
    share = (mass + 0.5) / (mass.sum() + 0.5 * op2_lm.CLASSES)
    total = mass.sum() + 0.5 * (len(count) + 2)
    for d, t in rows:
        score, base, before = 0.0, 0.0, model.classes[end]
        for w in [*(t or "").split(), None]:
            u = end if w is None else unit[w]
            n = uc[end] if w is None else count[w]
            c = model.classes[u]
            score += math.log10((table[before, c] + op2_lm.MU * share[c]) / (table[before].sum() + op2_lm.MU))
            score += math.log10((uc[u] + 0.5) / (mass[c] + 0.5 * size[c]))
            if len(units) <= u < end:
                score += math.log10((n + 0.5) / (uc[u] + 0.5 * (tv[u] + 1)))
            base += math.log10((n + 0.5) / total)
            before = c
        assert got[d].score == pytest.approx(score, abs=1e-6) and got[d].base_score == pytest.approx(base, abs=1e-6)
        assert (got[d].n_tokens, got[d].n_known) == (len((t or "").split()) + 1, sum(count[w] > 0 for w in (t or "").split()) + 1)


def test_words_outside_the_broadcast_score_the_same(spark, rows, monkeypatch):
    whole, small = scores(spark, rows, monkeypatch, 1 << 18), scores(spark, rows, monkeypatch, 100)
    assert (whole[0].classes == small[0].classes).all()
    for d, r in whole[1].items():
        assert small[1][d].score == pytest.approx(r.score, abs=1e-9) and small[1][d].n_known == r.n_known


def test_no_training_documents(spark, monkeypatch):
    _, got, _ = scores(spark, [(9001, "a b"), (9002, None)], monkeypatch, 1 << 18)
    assert (got[9001].n_tokens, got[9001].n_known, got[9002].n_tokens) == (3, 0, 1)

"""Pairs of the n-gram Jaccard join: texts of few common passages, near copies."""

import random

import numpy as np

from cadenza.llm import op1_jaccard


def _texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    pool = [" ".join(f"p{p}w{i}" for i in range(25)) for p in range(10)]
    texts = [" ".join(rng.sample(pool, 4)) for _ in range(60)]
    for i in range(6):                       # near copies: some words at the end go, some come
        texts.append(" ".join(texts[i].split()[:95 - i]) + f" x{i} y{i}")
    return texts


def _brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_texts_of_common_passages_make_no_pairs(spark, monkeypatch):
    sizes, real = {}, op1_jaccard.written

    def noted(df, name):
        out = real(df, name)
        sizes[name] = out.count() if name == "candidates" else None
        return out
    monkeypatch.setattr(op1_jaccard, "written", noted)
    texts = _texts(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op1_jaccard.jaccard_components(docs, 5, 80, 100).collect()}
    assert got == _brute(texts, 5, 80, 100)
    assert sizes["candidates"] <= len(texts) // 4


def test_sketches_never_differ_in_more_bits_than_the_sets_in_members():
    rng = np.random.default_rng(1)
    for n, extra in ((0, 3), (5, 0), (300, 40), (2000, 900)):
        both = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 64, extra, np.uint64)))) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (op1_jaccard._sketch(a) ^ op1_jaccard._sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
        assert extra < 40 or bits > 40

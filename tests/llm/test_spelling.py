"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from cadenza.llm import op11_spelling as op


def brute(rows, every=97):
    count = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: set() for w in n}
    for a in n:
        for b in n:
            if a != b and abs(len(a) - len(b)) <= 1:
                p = 0
                while p < min(len(a), len(b)) and a[p] == b[p]:
                    p += 1
                q = 0
                while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
                    q += 1
                if max(len(a), len(b)) - p - q == 1:
                    near[a].add(b)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéÿß") for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    for w in words[:60]:                       # planted edits
        at, c = rng.randrange(len(w)), rng.choice("abcÀ")
        words += [w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]]
    out = [(i, " ".join(rng.choice(words).title() if rng.random() < 0.3 else rng.choice(words[:40] + words) for _ in range(60))) for i in range(90)]
    long = "".join(rng.choice("xyz") for _ in range(700))
    chain = [f"{w} " * c for w, c in (("aabbccdd", 3), ("aabbccde", 6), ("aabbccee", 12), ("aabbceee", 24), ("aabceeee", 48), ("aaceeeee", 96))]
    return out + [(200, None), (201, ""), (None, "abcde abcde" * 3), (202, f"{long}, {long}1{long[:-1]} " * 9), (203, "x" * 5000 + " "),
                  (204, "-".join(chain)), (204, "-".join(chain)), (205, "日本語 a×b÷c Éabcd Éabcd Éabcd éabcd")]


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants(spark, rows, symbols):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = result(op.variants(op.vocabulary(docs, delete_every=97), symbols=symbols))
    assert got == brute(rows) and sum(bool(r[1]) for r in got) > 20


def test_pieces_keep_runs_whole(rows):
    import pyarrow as pa
    text = " ".join(t for _, t in rows if t)
    col = pa.array(["", text, None, "abc"])
    whole = []
    for _, data, offs in op.pieces(col, 4096):
        start, end, _, chars = op.runs(data, offs)
        whole += [data[a:b].tobytes().decode() for a, b in zip(start, end)]
        assert [len(w) for w in whole[-len(start):]] == chars.tolist()
    assert whole == re.findall("[A-Za-z\u00c0-\u00ff]+", text) + ["abc"]


def test_crc_of_runs():
    data = np.frombuffer(b"ab " + b"q" * 200 + b" xyz", np.uint8)
    start, end = np.array([0, 3, 204]), np.array([2, 203, 207])
    got = op.run_crc(data, start, end, np.array([zlib.crc32(b"7:")] * 3, np.uint32))
    assert got.tolist() == [zlib.crc32(b"7:ab"), zlib.crc32(b"7:" + b"q" * 200), zlib.crc32(b"7:xyz")]


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n long, word string")
    assert op.variants(op.vocabulary(docs)).collect() == []
    docs = spark.createDataFrame([(1, "hello hello hello hallo hallo hallo hallo hallo hallo", 5, "w")], "doc_id long, text string, n long, word string")
    assert result(op.variants(op.vocabulary(docs))) == [("hallo", "", "hallo", 6, 1, None), ("hello", "hallo", "hallo", 3, 1, 6)]

"""Line dedup against brute force: near lines of any kind, NULL ids, repeated rows, long texts."""

import random

import pytest

from cadenza.llm import op4_lines as op


def within_one(a, b):
    if a == b:
        return True
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return max(len(a), len(b)) - p - q <= 1


def brute(rows, min_chars=20, exact_chars=1):
    lines = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(op._SPACE)
            if len(line) >= exact_chars and line:
                lines.append(((d is not None, d or 0), k, line))
    first = {}
    for d, k, line in lines:
        first[line] = min(first.get(line, (d, k)), (d, k))
    gone = set()
    for d, k, line in lines:
        near = [o for o in first if len(line) >= min_chars and len(o) >= min_chars and abs(len(o) - len(line)) < 2 and within_one(line, o)]
        # a line goes with all its places if an earlier line than its first place is near it
        if first[line] < (d, k) or any(first[o] < first[line] for o in near):
            gone.add((d[1] if d[0] else None, k))
    return gone


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé日") for _ in range(rng.randrange(2, 7)))
    base = [" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    out = []
    for d in range(120):
        lines = []
        for _ in range(rng.randrange(6)):
            x = rng.choice(base)
            at, kind = rng.randrange(len(x)), rng.randrange(6)
            x = [x, x[:at] + "z" + x[at:], x[:at] + x[at + 1:], x[:at] + "y" + x[at + 1:], x + "qq", "  " + x + "\t"][kind]
            lines.append(x)
        out.append((rng.choice([d, None]) if d % 10 == 0 else d, rng.choice(["\n", "\r\n", "\n\n \n"]).join(lines)))
    long = " ".join(word() for _ in range(5000))
    out.append((None, "\n" * 40 + base[1] + "\n" + base[1]))
    return out + [(500, None), (501, ""), (502, "\n \n"), (503, base[0]), (503, base[0]), (504, long + "\n" + long[1:]), (505, "x\n" * 3000 + long[:-1])]


def test_removed_lines(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in op.removed_lines(docs, exact_chars=1).collect()}
    assert got == brute(rows) and any(d is None for d, _ in got)


def test_null_id_is_the_earlier_line(spark):
    line = "the quick brown fox jumps"
    docs = spark.createDataFrame([(None, line), (2, line[:5] + "X" + line[6:])], "doc_id long, text string")
    assert [tuple(r) for r in op.removed_lines(docs).collect()] == [(2, 0)]


def test_columns_stay(spark):
    rows = [(1, "a line of the page here\nmore", 5, "x", 1.0), (2, "a line of the page here", 5, None, 2.0), (3, None, None, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, place string, line double")
    got = sorted(tuple(r) for r in op.clean_documents(docs).collect())
    assert got == [(1, rows[0][1], 28, "x", 1.0), (3, "", 0, "y", None)]
    assert op.clean_documents(docs.limit(0)).collect() == []

"""The training-data operators against brute-force versions on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 90)))) for i in range(60)]
    for j in range(80):     # near copies of one text
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        out.append((100 + j, " ".join(w[:60]) + "\n" + " ".join(w[60:])))
    out += [(300, None), (301, ""), (302, "Ab c"), (303, "aB  c\n"), (304, "x " * 600), (305, " ".join(base)), (306, "日本 é's \t x")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(docs, rows, k, num, den):
    from cadenza.llm.op1_jaccard import jaccard_components
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, k, num, den).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_packed_among_loses_no_wanted_id(spark, docs, rows):
    from cadenza.llm.common import packed_among, unpack
    wanted = {i for i, _ in rows if i % 3 == 0} | {-7}
    more = docs.unionByName(spark.createDataFrame([(-7, "minus"), (None, "no id")], docs.schema))
    got = {r.doc_id: unpack(r.packed) for r in packed_among(more, spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()}
    texts = dict(rows) | {-7: "minus"}
    assert wanted <= set(got) and None not in got and len(got) < len(wanted) + 5
    assert all((texts[i] or "") == t for i, t in got.items())
    assert not packed_among(docs, spark.createDataFrame([], "doc_id long")).collect()


def test_substrings(docs, rows):
    from cadenza.llm.op7_substrings import dedup_substrings
    first, words = {}, {}
    for i, t in sorted(rows):
        w = words[i] = WORD.findall(t or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j:j + 13]), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < i:
                gone[j:j + 13] = [True] * 13
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in dedup_substrings(docs).collect()} == want


def _within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a == b or a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def test_lines(spark):
    from cadenza.llm.op4_lines import removed_lines
    line = "the quick brown fox jumps over the dog"
    rows = [(1, line + "\nshort"), (2, line[:9] + "X" + line[10:]), (3, line[1:]), (4, line + "s\n" + line), (5, "another line of enough characters"),
            (6, "short\n" + line[:20] + "YY" + line[22:]), (7, None), (8, line.replace("o", "0")), (9, "another line of en0ugh characters")]
    seen, want = [], set()
    for d, t in rows:
        for k, text in enumerate((t or "").split("\n")):
            if len(text) >= 20:
                if any(_within_one(text, s) for s in seen):
                    want.add((d, k))
                seen.append(text)
    got = removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_decontamination(spark, docs, rows):
    from cadenza.llm.op3_decontaminate import report
    own = [t for i, t in rows if i == 110][0].split()
    items = [(1, " ".join(own[3:20]).upper()), (2, "w1"), (3, None), (4, "no such words here")]
    sep = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = sep.findall((t or "").translate(LOW))
        for j in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[j:j + 13])].add(i)
    want = {}
    for d, t in rows:
        w, hit, found = sep.findall((t or "").translate(LOW)), set(), set()
        for x, ids in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j:j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    found |= ids
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(),
                   bool(hit) and 20 * len(hit) >= len(w))
    got = report(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_quality_counts(docs, rows):
    from pyspark.sql import functions as F

    from cadenza.llm.op10_quality import judge
    for r in judge(docs.withColumn("lang", F.lit("en"))).collect():
        t = dict(rows)[r.doc_id] or ""
        w, at, covered, seen, again = WORD.findall(t), collections.defaultdict(list), set(), set(), 0
        for j in range(len(w) - 2):
            at[tuple(w[j:j + 3])].append(j)
        for v in at.values():
            if len(v) > 1:
                covered |= {j + x for j in v for x in range(3)}
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), again, len(covered), failed)


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cadenza.llm.op6_token_ids import packed_rows
    from cadenza.llm.op8_bestfit import lower_bound, pack_documents
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    packed = pack_documents(docs, 256).toPandas()
    assert packed.sequence_id.nunique() == lower_bound(packed.length.to_numpy(np.int64), 256)
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256
    for r in packed.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    back = collections.defaultdict(dict)
    for r in packed_rows(docs, 256).collect():
        a = np.frombuffer(r.ids, "<u2")
        for j, (d, k) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            back[d][k] = a[r.cu_seqlens[j]:r.cu_seqlens[j + 1]].tolist()
    assert {d: sum((v[k] for k in sorted(v)), []) for d, v in back.items()} == ids


def test_chat_round_trip(spark):
    from cadenza.llm.op9_chat import PROBE, digest, escape, format_turns, unescape
    for text in (PROBE, "<\\|a", "<|", "<\\\\|", "a\\b<", ""):
        assert unescape(escape(text)) == text and "<|" not in escape(text)
    rows = [(1, 0, "user", PROBE), (1, 1, "assistant", "<\\|x"), (2, 0, "user", None), (2, 1, "assistant", PROBE)]
    turns = format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in digest(turns).collect()}
    for c in (1, 2):
        own = [(r, t or "") for i, _, r, t in rows if i == c]
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(own[1][1].encode()).hexdigest() and not got[c].rewrites
    rewriting = format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"),
                             lambda turns: f"{len(turns)}:" + "".join(t for _, t in turns), lambda t: t)
    assert rewriting.where("rewrites").count() == 2


def test_toxic_segments():
    from cadenza.llm.op5_toxicity import maximal_segments
    scores = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])      # the worked example of the published algorithm
    assert [s[2] for s in maximal_segments(scores)] == [4, 3, 7]


def test_empty_tables(spark):
    from cadenza.llm import op1_jaccard, op3_decontaminate, op4_lines, op7_substrings, op8_bestfit, op10_quality
    none = empty(spark)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (op1_jaccard.jaccard_components(none), op3_decontaminate.report(none, items), op4_lines.dedup_lines(none),
                op7_substrings.dedup_substrings(none), op8_bestfit.pack_documents(none), op10_quality.judge(none)):
        assert out.count() == 0

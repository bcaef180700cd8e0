"""The URL filter against a plain statement of its rules and models."""

import collections
import math
import random
import re
import zlib

import pytest

from cadenza.llm import op13_urls as op

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    after = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", after)[0]
    return host.translate(LOW), re.match(r"[^?#]*", after[len(host):])[0]


def rule_of(host, path):
    best = None
    for h, p, v in op.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, None)


def symbols(text):
    s = [op._SYMBOLS.index("0" if c.isascii() and c.isdigit() else c if c in op._SYMBOLS else "~") + 1 for c in text.translate(LOW)]
    return [0] * op.ORDER + s + [0]


def brute(urls):
    parts = [(u, *split(u)) for u in urls]
    judged = [(u, h, p, *rule_of(h, p)) for u, h, p in parts]
    held = lambda h, p: zlib.crc32((h + p).encode()) % op.HELD_OUT == 0
    count = {v: [collections.defaultdict(collections.Counter) for _ in range(op.ORDER + 1)] for v in ("allow", "block")}
    for _, h, p, _, v in judged:
        if v and not held(h, p):
            s = symbols(h + p)
            for i in range(op.ORDER, len(s)):
                for k in range(op.ORDER + 1):
                    count[v][k][tuple(s[i - k:i])][s[i]] += 1
    if not all(c[0] for c in count.values()):
        return [(u, h, p, r, v or "allow") for u, h, p, r, v in judged]

    def ratio(context, c):
        p = dict.fromkeys(count, 1 / 32)
        for k in range(op.ORDER + 1):
            own = context[len(context) - k:]
            if k and sum(sum(count[v][k][own].values()) for v in count) < op.MIN_EVIDENCE:
                break
            for v in count:
                seen = count[v][k][own]
                n, t = sum(seen.values()), len([x for x in seen.values() if x])
                if n:
                    p[v] = (seen[c] + t * p[v]) / (n + t)
        return round(math.log(p["allow"] / p["block"]) * op.MICRO)
    scores = []
    for _, h, p, _, _ in judged:
        s = symbols(h + p)
        scores.append(sum(ratio(tuple(s[i - op.ORDER:i]), s[i]) for i in range(op.ORDER, len(s))) / (len(s) - op.ORDER) / op.MICRO)
    bins = [(math.floor(x * 1000), v) for x, (_, h, p, _, v) in zip(scores, judged) if v and held(h, p)]
    a, b = [x for x, v in bins if v == "allow"], [x for x, v in bins if v == "block"]
    cut = 0
    if a and b:
        at = range(min(a + b), max(a + b) + 2)
        good = {c: sum(x >= c for x in a) * len(b) + sum(x < c for x in b) * len(a) for c in at}
        best = [c for c in at if good[c] == max(good.values())]
        cut = (best[0] + best[-1]) // 2
    return [(u, h, p, r, v or ("allow" if math.floor(x * 1000) >= cut else "block")) for x, (u, h, p, r, v) in zip(scores, judged)]


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(13)
    hosts = ["www.thth.example.org", "cheap-pills.example.com", "m.Casino-Win.example.net", "a.example.com", "news.ten.net", "org", "x.org:80"]
    out = [f"http{'s' * rng.randrange(2)}://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(200)}"
           f"{rng.choice(['', '.html', '?page=2', '#top', '/'])}" for _ in range(300)]
    return out + out[:20] + ["http://t.example.com/de/7"] * 200 + [
        None, "", "no scheme", "://", "http://", "ftp://ORG/A?://b", "a://b://c/d", "http://example.org/es", "http://badexample.org/es/1", "x://com/fr/\n\u00e9\U0001f600",
        "http://h.net/" + "a1" * 20000, "http://q.com?x=/de/", "http://org#/"]


def test_verdicts(spark, urls):
    pages = spark.createDataFrame([(i // 2, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, score string").repartition(4)
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in op.judge(pages).collect())
    want = collections.Counter((i // 2, *r[1:]) for i, r in enumerate(brute(urls)))
    assert got == want and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (None, None), (1, "http://a.net/x")], "page_id long, url string")
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in op.judge(pages).collect())
    assert got == [(0, "", "", None, "allow")] + [(1, "a.net", "/x", None, "allow")] * 2
    assert op.judge(pages.limit(0)).collect() == []
    assert {r.rule for r in op.judge(pages, rules=[]).collect()} == {None}


def test_main_path_is_native(spark, urls):
    pages = spark.createDataFrame(enumerate(urls), "page_id long, url string")
    plan = op.judge(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

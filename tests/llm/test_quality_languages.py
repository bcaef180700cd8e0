"""Divergence verdicts of languages of all sizes."""

import random


def _text(rng, letters, common, n=80):
    words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(n)]
    for i in range(0, n, 2):
        words[i] = common[(i // 2) % len(common)]
    return " ".join(words)


def test_every_language_is_judged_by_itself(spark):
    from cadenza.llm.op10_quality import judge
    rng = random.Random(11)
    latin, greek = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω"
    rows = []
    for k in range(70):          # more languages than 63; the last one, of the fewest documents, in another script
        letters, common = (greek, ["και", "το", "να", "του"]) if k == 69 else (latin, ["foo", "bar", "baz", "quux"])
        rows += [(1000 * k + i, _text(rng, letters, common), f"l{k:02d}") for i in range(20 if k == 69 else 21)]
    rows += [(90_000 + i, _text(rng, greek, ["δεν"]), lang) for i, lang in enumerate(["few", "few", None])]
    # the letters of its language, none of its common words
    rows.append((99_999, " ".join("".join(rng.choice(latin) for _ in range(6)) for _ in range(80)), "l00"))
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(r.kept for d, r in got.items() if d != 99_999)
    assert all(got[90_000 + i].char_distance is None for i in range(3)) and got[69_000].char_distance < 0.1
    assert not got[99_999].kept and got[99_999].word_distance > 0.275

"""Cases that earlier rounds got wrong: repeated rows, NULL ids, long patterns, many groups."""

import numpy as np
import pytest


def test_equal_pieces_in_many_groups(spark):
    from cadenza.llm.op8_bestfit import lower_bound, pack
    lengths = [2] * 70_000 + [1 + i % 4 for i in range(5000)]
    rows = spark.createDataFrame([(None if i % 3 else 5, 0, 0, n, 7) for i, n in enumerate(lengths)],
                                 "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(rows, capacity=4, group=1000).toPandas()
    fill = out.groupby("sequence_id")["length"].sum()
    assert len(out) == len(lengths) and fill.max() <= 4
    # gapless from 0 in every sequence
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id")["length"].cumsum() - out["length"] == out["offset"]).all()
    bound = lower_bound(np.array(lengths), 4)
    assert set(out["total_bound"]) == {bound} and bound <= len(fill) <= 1.002 * bound
    assert (out["group_bound"] <= out["group_bins"]).all()


def test_contaminated_rows_without_an_id(spark):
    from cadenza.llm.op3_decontaminate import drop_contaminated, remove_spans, report
    item = " ".join(f"word{i}" for i in range(20))
    rows = [(None, item), (None, "clean text of its own"), (None, item), (1, "Xy " + item + " z"), (1, "Xy " + item + " z"), (2, None), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("a", item), (None, "clean"), ("b", None), ("c", "not there")], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in report(docs, items).collect())
    assert got == [(0, 5, 0, 0, False), (0, 20, 20, 1, True), (1, 22, 20, 1, True), (2, 0, 0, 0, False), (3, 1, 0, 0, False)]
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {rows[1], rows[5], rows[6]}
    assert {(r.doc_id, r.text) for r in remove_spans(docs, items).collect()} == {(None, ""), (None, rows[1][1]), (1, "xy z"), (2, ""), (3, "clean")}


@pytest.mark.parametrize("length", [5, 16, 24, 40])
def test_patterns_of_any_length(length):
    from cadenza.llm.fm import FMIndex
    rng = np.random.default_rng(length)
    base = rng.integers(1, 4, 60)
    text = np.concatenate([np.append(base[rng.integers(0, 9):], 0) for _ in range(12)] + [rng.integers(1, 4, 200), [0]])
    index = FMIndex(text, length)
    places = [i for i in range(len(text) - length) if (text[i:i + length] > 0).all()]
    windows = {}
    for i in places:
        windows.setdefault(tuple(text[i:i + length]), []).append(i)
    start, lo, hi = index.matches(text, np.array(places), length)
    # a window that occurs once is given up on the way
    want = {i: len(windows[tuple(text[i:i + length])]) for i in places}
    got = {int(s): int(b - a) for s, a, b in zip(start, lo, hi)}
    assert {i: n for i, n in got.items() if n > 1} == {i: n for i, n in want.items() if n > 1} and max(want.values()) > 1
    with pytest.raises(ValueError):
        index.matches(text, np.array(places), length + 1)


def test_repeats_hidden_by_another_window(spark):
    from cadenza.llm.op10_quality import base_counts
    rows = [(1, "a b c a b c a b c d e f", "xx"), (2, " ".join(f"w{i % 37}" for i in range(3000)), None), (3, None, "en"), (4, "a b", "en")]
    got = {r.doc_id: r.n_repeat_words for r in base_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: 9, 2: 3000, 3: 0, 4: 0}

"""Short lines and the exact step of line dedup."""


def test_equal_short_lines_go(spark):
    from cadenza.llm.op4_lines import clean_documents, dedup_lines
    rows = [(1, "Read more\nfirst text"), (2, " Read more\n\n \nsecond text"), (3, "Read mora\nRead more\t"), (4, "first text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs).collect()}
    # equal lines only: one edit is not enough under 20 characters, and blank lines stay
    assert got == {1: (rows[0][1], 0), 2: ("\n \nsecond text", 1), 3: ("Read mora", 1), 4: ("", 1)}
    assert {r.doc_id for r in clean_documents(docs).collect()} == {1, 2, 3}

"""Chat templates that look back, and texts that look like markers."""

SCHEMA = "conv_id long, turn long, role string, text string"


def test_long_conversation_of_a_template_that_looks_back(spark):
    from cadenza.llm.op9_chat import format_turns
    rows = [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(530)]

    def numbered(turns):
        return "BEGIN\n" + "".join(f"[{i}] {role}: {text}\n" for i, (role, text) in enumerate(turns))

    got = format_turns(spark.createDataFrame(rows, SCHEMA), numbered, lambda t: t).orderBy("position").collect()
    whole = numbered([(r[2], r[3]) for r in rows])
    assert "".join(r.rendered for r in got) == whole and not any(r.rewrites for r in got)
    assert all(whole[r.start:r.end] == r.rendered and whole[r.text_start:r.text_end] == rows[r.position][3] for r in got)

    def rewriting(turns):       # an early turn changes when turn 520 comes
        return "".join(f"{'old' if i == 3 and len(turns) > 520 else role}: {text}\n" for i, (role, text) in enumerate(turns))

    got = format_turns(spark.createDataFrame(rows, SCHEMA), rewriting, lambda t: t)
    assert [r.position for r in got.where("rewrites").collect()] == [520]


def test_texts_that_occur_in_markers(spark):
    from cadenza.llm.op9_chat import END, START, format_turns
    texts = ["end", "im", "|", "<", ">", "\n", "assistant", "", f"x{END}", ""]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    for r in format_turns(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.text_start == len(f"{START}assistant\n") and r.in_loss
        assert r.rendered[r.text_end:] == f"{END}\n"


def test_declared_window_gives_the_same_rows(spark):
    from cadenza.llm.op9_chat import chat_template, format_turns
    rows = [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(530)]
    c = spark.createDataFrame(rows, SCHEMA)
    assert format_turns(c).collect() == format_turns(c, chat_template, context_free=False).collect()

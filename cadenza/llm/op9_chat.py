"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. The
operator renders the prefixes of one, two, three ... turns and compares each
output with the one before: what was added is the turn's span. If the earlier
output isn't a prefix of the later one, the template rewrites history; the row
says so (``rewrites``) and its span starts where the two outputs part. The
place of the turn's text is where a second rendering, with a mark in its stead,
has that mark; it gives the loss mask (assistant texts only).

Rows of a conversation stream through one task in order of turn; the task keeps
the current prefix only. Every prefix is rendered whole, so the work grows with
the square of a conversation's length. Only for a template that the caller
declares ``context_free`` (a turn's rendering depends on that turn alone) is a
prefix the last ``CONTEXT_TURNS`` turns, in conversations of any length, which gives
the same rows and keeps cost and memory bounded; ``chat_template`` is one. A turn
whose text can't be placed (a template that refuses the mark) has text_start -1.

Edge cases: NULL text is empty, NULL role reads as ``user``, NULL turns come
first; rows that tie on turn are ordered by role, then text. Rows with a NULL
conv_id form one conversation of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import small_batches, table

START, END = "<|im_start|>", "<|im_end|>"
CONTEXT_TURNS = 8
MARKS = [chr(c) for c in range(0xE000, 0xF900)]     # characters of private use
Turn = tuple[str, str]

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Make control strings inside a text harmless: one backslash goes into
    every ``<|`` (and into its escaped forms, so that it can be undone)."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def chat_template(turns: list[Turn]) -> str:
    return "".join(f"{START}{role}\n{escape(text)}{END}\n" for role, text in turns)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning of two strings."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


class _Renderer:
    """Successive prefixes of one conversation."""

    def __init__(self, template: Callable[[list[Turn]], str], context_free: bool = False):
        self.template, self.context_free = template, context_free
        self.turns, self.out, self.done, self.n = [], "", 0, 0

    def place(self, own: str, encode: Callable[[str], str], floor: int) -> int:
        """Where the last turn's text begins in the output, or -1: the place of a
        mark, a character the output lacks, that is rendered instead of it."""
        role, text = self.turns[-1]
        mark = next((c for c in MARKS if c not in self.out and encode(c) == c), None)
        if mark is None:
            return -1
        try:
            probe = self.template([*self.turns[:-1], (role, mark)])
        except Exception:       # a template may refuse the mark; the place is then unknown
            return -1
        at = probe.rfind(mark)
        there = at >= floor and probe[:at] == self.out[:at] and self.out.startswith(own, at)
        return at if there else -1

    def add(self, role: str, text: str) -> tuple[str, int, bool]:
        """(added output, where it starts, whether history was rewritten)."""
        if self.context_free and len(self.turns) > CONTEXT_TURNS:
            self.turns = self.turns[-CONTEXT_TURNS:]
            before = self.template(self.turns)
            self.done += len(self.out) - len(before)
            self.out = before
        self.turns.append((role, text))
        self.n += 1
        out = self.template(self.turns)
        rewrites = not out.startswith(self.out)
        at = _shared(self.out, out) if rewrites else len(self.out)
        added, start, self.out = out[at:], self.done + at, out
        return added, start, rewrites


SCHEMA = ("conv_id long, position long, role string, rendered string, start long, end long, "
          "text_start long, text_end long, in_loss boolean, rewrites boolean")


def _formatter(template, encode, context_free):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, r = object(), None
        for pdf in frames:
            rows = []
            for conv, role, text in zip(pdf.conv_key, pdf.role, pdf.text, strict=True):
                if conv != key:
                    key, r = conv, _Renderer(template, context_free)
                k = r.n
                added, start, rewrites = r.add(role, text)
                own = encode(text)
                at = r.place(own, encode, start - r.done)
                at = at - (start - r.done) if at >= 0 else -1
                rows.append((None if conv == "" else int(conv), k, role, added, start, start + len(added),
                             start + at if at >= 0 else -1, start + at + len(own) if at >= 0 else -1,
                             role == "assistant" and at >= 0, rewrites))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(
                {"conv_id": "Int64"})
    return run


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_key").sortWithinPartitions("conv_key", *order)


def format_turns(conversations: DataFrame, template: Callable[[list[Turn]], str] = chat_template,
                 encode: Callable[[str], str] = escape, context_free: bool | None = None) -> DataFrame:
    """One row per turn: its rendered span, place, mask and verdict. ``encode``
    is what the template does to a text; ``context_free`` says that the template
    renders each turn by itself (known of ``chat_template``, else assumed false)."""
    small_batches(conversations.sparkSession)
    context_free = template is chat_template if context_free is None else context_free
    c = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _ordered(c, "turn", "role", "text").mapInPandas(_formatter(template, encode, context_free), SCHEMA)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)
_DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, rewrites boolean")


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads the formatted turns back; running hashes, so no conversation is held."""
    columns = [c.split()[0] for c in _DIGEST.split(", ")]
    key, state = None, None

    def row(conv, s):
        return (None if conv == "" else int(conv), s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5])

    for pdf in frames:
        rows = []
        for conv, rendered, start, a, b, loss, rewrites in zip(
                pdf.conv_key, pdf.rendered, pdf.start, pdf.text_start, pdf.text_end, pdf.in_loss, pdf.rewrites, strict=True):
            if state is None or conv != key:
                if state is not None:
                    rows.append(row(key, state))
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
            m = _TURN.fullmatch(rendered)
            role, text = (m[1], unescape(m[2])) if m else ("", rendered)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss:
                own = unescape(rendered[a - start:b - start])
                state[2] += len(own)
                state[3].update(own.encode())
            state[4] += len(rendered)
            state[5] |= bool(rewrites)
        yield pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})
    if state is not None:
        yield pd.DataFrame([row(key, state)], columns=columns).astype({"conv_id": "Int64"})


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns."""
    f = formatted.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    return _ordered(f, "position").mapInPandas(_digests, _DIGEST)


PROBE = f"{END}{START}assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations plus conversation -1, whose texts hold control strings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest(format_turns(c.unionByName(probe)))

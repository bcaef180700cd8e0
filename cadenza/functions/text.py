"""String column functions: list literals, white space, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.schema import MISSING_MARKERS

# Python-style list literals (single quotes, escaped quotes) parse as lenient JSON.
LIST_LITERAL_OPTIONS = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
}

# every character Python treats as white space (str.isspace)
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_EDGE_SPACE = "^" + _SPACE + "+|" + _SPACE + "+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python ``repr`` escapes that JSON lacks: ``\xNN`` and ``\UNNNNNNNN``. The
# lookbehind keeps an escaped backslash (``\\x41`` is text, not an escape).
_UNESCAPED = r"(?<!\\)((?:\\\\)*)"
_HEX2 = _UNESCAPED + r"\\x([0-9a-fA-F]{2})"
_HEX8 = _UNESCAPED + r"\\U([0-9a-fA-F]{8})"
_MARK = "\ufdd0"  # a noncharacter: stands for a code point until after parsing


def _decode_marks(x: Column) -> Column:
    """Replace each mark + 8 hex digits by that code point (UTF-32 decode)."""
    parts = F.split(x, _MARK)
    rest = F.transform(F.slice(parts, 2, F.size(parts) - 1),
                       lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 8)), "UTF-32"),
                                          F.substring(p, 9, 1 << 30)))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def parse_list_literal(c) -> Column:
    """``['a', "b's"]`` -> array<string>; NULL when the text is not a list.

    Lenient JSON (single quotes, any escaped character) reads Python list
    literals; ``\\xNN`` becomes JSON ``\\u00NN`` first and ``\\UNNNNNNNN`` is
    decoded after parsing. Nothing is evaluated.
    """
    raw = _c(c)
    # the escape passes only run on the (rare) texts that hold a backslash
    escaped = F.regexp_replace(F.regexp_replace(raw, _HEX2, r"$1\\u00$2"), _HEX8, "$1" + _MARK + "$2")
    text = F.when(raw.contains("\\"), escaped).otherwise(raw)
    arr = F.from_json(text, "array<string>", LIST_LITERAL_OPTIONS)
    decoded = F.transform(arr, lambda x: F.when(F.instr(x, _MARK) > 0, _decode_marks(x)).otherwise(x))
    return F.when(raw.contains("\\U"), decoded).otherwise(arr)


def list_or_empty(c) -> Column:
    """Full list, empty when the text is not a list."""
    return F.coalesce(parse_list_literal(c), F.array().cast("array<string>"))


# a list of plain single-quoted strings (no quote or backslash inside), as
# Python writes most lists: its first element needs no JSON parser
_SIMPLE_LIST = r"^\['([^'\\]*)'(?:, '[^'\\]*')*\]$"
_SIMPLE_FIRST = r"^\['([^'\\]*)'"


def first_of_list(c, default: str | None) -> Column:
    """First element of a list literal; ``default`` for empty or bad text.
    Plain lists take a regular-expression fast path; everything else goes
    through :func:`parse_list_literal`."""
    col = _c(c)
    parsed = F.coalesce(F.try_element_at(parse_list_literal(col), F.lit(1)), F.lit(default).cast("string"))
    return F.when(col.rlike(_SIMPLE_LIST), F.regexp_extract(col, _SIMPLE_FIRST, 1)).otherwise(parsed)


def trim_space(c) -> Column:
    """Strip all white space (tabs, new lines, unicode spaces) at both ends."""
    return F.regexp_replace(_c(c), _EDGE_SPACE, "")


def missing_marker_to_null(c) -> Column:
    """Text a CSV reader treats as missing becomes NULL."""
    col = _c(c)
    return F.when(col.isin(MISSING_MARKERS), F.lit(None).cast("string")).otherwise(col)


def search_match(columns: list, query: str | None, literal: bool = False) -> Column:
    """OR over columns, ignoring case; the query is a regular expression unless
    ``literal``. Missing text never matches; an empty query matches all rows."""
    if not query:
        return F.lit(True)
    preds = []
    for c in columns:
        col = _c(c)
        if literal:
            p = F.lower(col).contains(query.lower())
        else:
            p = col.rlike("(?i)" + query)
        preds.append(F.coalesce(p, F.lit(False)))
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out

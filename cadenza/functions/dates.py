"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def release_year(c, fmt: str = "yyyy-MM-dd", default: int = 0) -> Column:
    """Year of a mixed-precision date text (``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``).

    Full dates are parsed; anything else falls back to its first four
    characters as a number, then to ``default``. Never raises under ANSI mode.
    """
    col = F.col(c) if isinstance(c, str) else c
    parsed = F.year(F.try_to_timestamp(col, F.lit(fmt)))
    prefix = F.substring(col, 1, 4).try_cast("int")
    return F.coalesce(parsed, prefix, F.lit(default)).cast("int")

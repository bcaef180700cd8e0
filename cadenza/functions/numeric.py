"""Numeric and categorical column functions (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.schema import (CATEGORY_FALLBACK, CATEGORY_THRESHOLDS, ENERGY_BINS,
                            SCORE_LABELS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN compares greater than any number in Spark; make it NULL instead."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (greatest/least would skip it)."""
    col = _c(c)
    out = col
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return F.when(col.isNull(), F.lit(None)).otherwise(out)


def popularity_category(c) -> Column:
    """Hit / Mainstream / Emerging / Underground; missing -> Underground."""
    col = _c(c)
    out = None
    for limit, label in CATEGORY_THRESHOLDS:
        out = (F.when(col >= limit, label) if out is None
               else out.when(col >= limit, label))
    return out.otherwise(CATEGORY_FALLBACK)


def energy_category(c) -> Column:
    """Right-closed bins; 0, values above 1 and missing give NULL."""
    col = _c(c)
    out = None
    for lo, hi, label in ENERGY_BINS:
        cond = (col > lo) & (col <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def flag(predicate: Column) -> Column:
    """Predicate as 0/1 integer (missing compares false -> 0)."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def decade(year) -> Column:
    """1994 -> '1990s'; 0 -> '0s'."""
    y = _c(year)
    return F.concat((F.floor(y / 10) * 10).cast("bigint").cast("string"), F.lit("s"))


def score_label(score) -> Column:
    """Category with its display mark, from the unrounded score."""
    cat = popularity_category(score)
    out = F.lit(None).cast("string")
    for k, v in SCORE_LABELS.items():
        out = F.when(cat == k, v).otherwise(out)
    return out


def round_to(c, digits: int = 0) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    ``F.round`` rounds the shortest decimal text of a double, so 0.30215
    (stored just below the tie) would go up; Python and DuckDB go down.
    """
    scale = float(10 ** digits)
    return F.round(_c(c) * F.lit(scale), 0) / F.lit(scale)


def round_score(c) -> Column:
    """A score in [0, 2**20) rounded to two digits as Python's ``round`` does:
    the stored binary value decides (2.675 is below its tie and goes down), exact
    ties go to the even digit. The two parts of the score times 100 are exact, so
    the comparison with the tie is too."""
    x = _c(c)
    high = F.floor(x * F.lit(2.0 ** 20)) / F.lit(2.0 ** 20)
    low = (x - high) * F.lit(100.0)
    whole = F.floor(high * F.lit(100.0)).cast("double")
    over = high * F.lit(100.0) - whole - F.lit(0.5)
    up = (over > -low) | ((over == -low) & (whole % 2 == 1))
    return F.when(up, whole + 1).otherwise(whole) / F.lit(100.0)


def pearson(x, y) -> Column:
    """Pearson correlation over rows where both sides are present; NULL when
    either side has zero variance (``corr`` raises there under ANSI mode)."""
    a, b = _c(x).cast("double"), _c(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a2, b2), F.stddev_pop(a2) * F.stddev_pop(b2))

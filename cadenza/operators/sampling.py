"""Exact, repeatable samples and splits keyed on a hash of (key, seed).

Spark's ``sample``/``randomSplit`` depend on the partitioning and give only an
approximate size. Here every row gets ``md5(key|seed)``; order by that hash is
a fixed random permutation that does not depend on partitions, executors or
the engine (DuckDB's ``md5`` gives the same text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.schema import SEED

BUCKET_HEX = 4          # first 4 hex digits -> 65,536 buckets
BOUNDARY = 10_000       # rows of the last bucket that are put in order
FRACTION_HEX = 12       # first 12 hex digits -> fraction with 48 bits


def row_hash(key: str | list[str], seed: int = SEED) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_fraction(key: str | list[str], seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 48 bits of the row hash."""
    prefix = F.substring(row_hash(key, seed), 1, FRACTION_HEX)
    return F.conv(prefix, 16, 10).cast("bigint") / float(16 ** FRACTION_HEX)


def exact_cut(with_hash: DataFrame, n: int, column: str = "_h") -> tuple[str, int]:
    """(prefix, left): the ``n`` smallest hashes are those that sort below
    ``prefix``, and ``left`` more of those that begin with it.

    A distributed order statistic: counts by the next ``BUCKET_HEX`` digits (at most
    65,536 rows, combined map-side) give the bucket where the running count reaches
    ``n``; that bucket alone is counted by its next digits, until all of it is
    wanted, it holds at most ``BOUNDARY`` rows, or no digits are left.
    """
    prefix, left, rows = "", n, with_hash
    while True:
        digits = F.substring(F.col(column), len(prefix) + 1, BUCKET_HEX)
        counts = rows.groupBy(digits.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        cut = counts.withColumn("_cum", upto).where(F.col("_cum") >= left).orderBy("_b").first()
        if cut is None:                       # fewer rows than wanted
            return "~", 0
        prefix, left = prefix + cut["_b"], left - (cut["_cum"] - cut["_n"])
        if left == cut["_n"] or cut["_n"] <= BOUNDARY or len(prefix) >= 32:
            return prefix, left
        rows = rows.where(F.col(column).startswith(prefix))


def sample_exact(df: DataFrame, n: int, key: str | list[str], seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, no replacement, the same rows on any
    partitioning: the first ``n`` rows in (hash, key) order.

    Rows below the cut are a plain filter; only the boundary bucket, of a bounded
    number of rows where keys are unique, is put in order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    with_h = df.withColumn("_h", row_hash(keys, seed))
    prefix, left = exact_cut(with_h, n)
    below = with_h.where(F.col("_h") < prefix)
    if not left:
        return below.drop("_h")
    boundary = with_h.where(F.col("_h").startswith(prefix)).orderBy("_h", *keys).limit(left)
    return below.unionByName(boundary).drop("_h")


def exact_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = SEED, out: str = "is_test") -> DataFrame:
    """M3 as an exact share: ``out`` is true for the ceil(``test_fraction`` rows)
    rows that come first in (hash, key) order. Rows that share their key with the
    last of them, beyond the share, stay out by their order among equal ones only
    if keys are unique; equal keys go to the same side."""
    with_h = df.withColumn("_h", row_hash(key, seed))
    n = -(-with_h.count() * round(test_fraction * 10 ** 9) // 10 ** 9)
    if not n:
        return df.withColumn(out, F.lit(False))
    prefix, left = exact_cut(with_h, n)
    last = None
    if left:                                  # the hash of the last row, out of a bounded bucket
        top = with_h.where(F.col("_h").startswith(prefix)).select("_h").orderBy("_h").limit(left)
        last = top.agg(F.max("_h")).first()[0]
    flag = F.col("_h") < prefix if last is None else F.col("_h") <= last
    return with_h.withColumn(out, flag).drop("_h")


def split_flag(key: str | list[str], test_fraction: float = 0.2, seed: int = SEED) -> Column:
    """True for test rows: hash fraction below ``test_fraction``. One split
    column serves every task (no shuffle, no partition dependence)."""
    return hash_fraction(key, seed) < F.lit(test_fraction)


def train_test_split(df: DataFrame, key: str | list[str], test_fraction: float = 0.2,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    flagged = df.withColumn("_is_test", split_flag(key, test_fraction, seed))
    return (flagged.where(~F.col("_is_test")).drop("_is_test"),
            flagged.where(F.col("_is_test")).drop("_is_test"))

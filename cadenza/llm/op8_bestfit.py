"""Best-fit packing certified by lower bounds.

Documents become pieces of at most ``CAPACITY`` tokens; the pieces are dealt
into groups of about ``GROUP`` by a hash, and each group packs its own with
best-fit decreasing. A group's lower bound is the largest over a family of
dual-feasible functions (the Martello-Toth threshold functions, the identity
among them, and the Fekete-Schepers rounding functions): no packing of the group
has fewer sequences. A group that meets its bound is certified and keeps all but
its emptiest sequence; one with a gap gives up its emptiest sequences, twice the
gap. What was given up is dealt into new groups and packed again, until one
group remains or nothing is gained. So no group grows with the data, and the
rounds shrink geometrically.

Edge cases: NULL or empty text is a document of one token (the end id). Repeated
rows are packed separately. NULL ids stay NULL. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import documents, id_text, map_arrow, written

CAPACITY = 2048
GROUP = 20_000
ROUNDS = 8
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenise(capacity: int, path: str | None):
    def run(batches):
        from cadenza.llm import tokens

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            rows = []
            for row, ids in tokens.documents_of(batch, path):
                raw = ids.astype("<u4")
                for k, (s, n) in enumerate(tokens.pieces(len(ids), capacity)):
                    rows.append((ids_of[row], k, s, n, zlib.crc32(raw[s:s + n].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return map_arrow(id_text(docs), _tokenise(capacity, path), _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound of the dual-feasible functions on these lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length from 0 to ``capacity``."""
    count = count.astype(np.int64)
    size = np.arange(capacity + 1)
    total = count * size
    up_count, up_total = np.cumsum(count[::-1])[::-1], np.cumsum(total[::-1])[::-1]
    best = -(-int(total.sum()) // capacity)
    for t in range(1, capacity // 2 + 1):   # below t: 0; above capacity - t: a whole sequence; else the length
        big = int(up_count[capacity - t + 1]) if capacity - t + 1 <= capacity else 0
        mid = int(up_total[t] - (up_total[capacity - t + 1] if capacity - t + 1 <= capacity else 0))
        best = max(best, -(-(big * capacity + mid) // capacity))
    for k in range(1, 32):                  # u(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k
        whole = (k + 1) * size % capacity == 0
        # in units of 1 / (k * capacity), to stay exact
        value = np.where(whole, size * k, ((k + 1) * size // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, and the fill of every sequence. The
    open capacities are the bits of one whole number, so the smallest that fits
    is the lowest bit at or above the length."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    open_bits, by_left = 0, {}
    for i in order.tolist():
        n = int(lengths[i])
        fits = open_bits >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            stack = by_left[left]
            b = stack.pop()
            if not stack:
                open_bits ^= 1 << left
        else:
            b, left = len(fill), capacity
            fill.append(0)
        of[i], offset[i] = b, fill[b]
        fill[b] += n
        left -= n
        if left:
            by_left.setdefault(left, []).append(b)
            open_bits |= 1 << left
    return of, offset, np.array(fill, np.int64)


_PACKED = _PIECES + ", row long, bin long, offset long, given_up boolean, bins long, bound long"


def _pack(capacity: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "row"], ascending=[False, True, True, True, True, True],
                              na_position="last").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        of, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        gap = len(fill) - bound
        give = 0 if last else 2 * gap + 1
        up = np.zeros(len(fill), bool)
        up[np.argsort(fill, kind="stable")[:give]] = True
        up &= fill < capacity
        return pdf.drop(columns="part").assign(bin=of, offset=offset, given_up=up[of], bins=len(fill), bound=bound)
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence and place, its group's sequences and bound, and the table's bound."""
    rest = written(pieces.withColumn("row", F.monotonically_increasing_id()), "token-pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("length").count().collect():        # at most ``capacity`` rows
        count[r.length] = r["count"]
    total = F.lit(bound_of_counts(count, capacity)).cast("long")
    n, done, k = int(count.sum()), None, 0
    while True:
        parts = max(1, -(-n // group))
        last = parts == 1 or k == ROUNDS - 1
        part = F.pmod(F.xxhash64("row", F.lit(k)), F.lit(parts))
        packed = rest.withColumn("part", part).groupBy("part").applyInPandas(
            _with_part(_pack(capacity, last)), _PACKED + ", part long")
        packed = written(packed, f"packed-{k}")
        # round, group and sequence of the group in bits of their own; a group has far less than 2**24 pieces
        sequence = F.shiftleft(F.lit(k).cast("long"), 59) + F.shiftleft(F.col("part"), 24) + F.col("bin")
        kept = packed.where("NOT given_up").select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset",
                                                   F.col("bins").alias("group_bins"), F.col("bound").alias("group_bound"), total.alias("total_bound"))
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        rest = packed.where("given_up").select("doc_id", "piece", "start", "length", "ids_crc32", "row")
        n, k = rest.count(), k + 1


def _with_part(f):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        if len(pdf) >= 1 << 24:
            raise ValueError("a group of 2**24 pieces: choose a smaller one")
        return f(pdf).assign(part=part)
    return run


def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, path: str | None = None) -> DataFrame:
    return pack(token_pieces(docs, capacity, path), capacity, group)

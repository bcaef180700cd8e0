"""Token ids as packed binary rows.

Each task tokenises its documents and packs them, ``BUFFER`` tokens at a time,
with best-fit decreasing; the smallest open capacity that fits is found in a
segment tree over capacities. Documents over ``CAPACITY`` tokens are split
without loss. One row is one sequence: its ids as little-endian numbers of
``ID_BYTES`` bytes, padded with the end id to a full matrix row, the cumulative
segment lengths, the places where positions restart, and per segment the
document, its piece and the tokens before that piece. Nothing is shuffled.

Edge cases: NULL or empty text is a document of one token (the end id). Repeated
rows are packed separately; a NULL doc_id stays NULL in the list. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.common import documents, id_text, small_batches

CAPACITY = 2048
BUFFER = 2_000_000          # tokens that a task packs at a time
ID_BYTES = 2                # the vocabulary has fewer than 65,536 ids
SCHEMA = ("sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<long>, pieces array<int>, starts array<long>")
_ARROW = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())),
                    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
                    ("starts", pa.list_(pa.int64()))])


class CapacityTree:
    """Counts open sequences by the capacity they have left; inner nodes hold
    the sum below, so the next capacity at or above a length is found in
    logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, left: int, by: int) -> None:
        i = self.size + left
        while i:
            self.count[i] += by
            i >>= 1

    def at_least(self, n: int) -> int:
        """The smallest open capacity not below ``n``, or -1."""
        i = self.size + n
        if self.count[i]:
            return n
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:      # a right neighbour holds some: go down to its leftmost
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the pieces of every sequence, by index."""
    tree, by_left, out = CapacityTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda j: (-lengths[j], j)):
        left = tree.at_least(lengths[i])
        if left < 0:
            b, left = len(out), capacity
            out.append([])
        else:
            b = by_left[left].pop()
            tree.add(left, -1)
        out[b].append(i)
        left -= lengths[i]
        if left:
            by_left.setdefault(left, []).append(b)
            tree.add(left, 1)
    return out


def _packer(capacity: int, buffer: int, id_bytes: int, path: str | None):
    def run(batches):
        from cadenza.llm import tokens

        part, made = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, made
            rows = []
            for own in pack_lengths([len(h[3]) for h in held], capacity):
                ids = np.concatenate([held[i][3] for i in own])
                cu = np.concatenate(([0], np.cumsum([len(held[i][3]) for i in own]))).astype(np.int32)
                row = np.full(capacity, tokens.END_ID, f"<u{id_bytes}")
                row[:len(ids)] = ids
                rows.append(((part << 32) + made, row.tobytes(), len(ids), cu.tolist(), cu[:-1].tolist(),
                             [held[i][0] for i in own], [held[i][1] for i in own], [held[i][2] for i in own]))
                made += 1
            held, size = [], 0
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[lo:lo + 256], strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for row, ids in tokens.documents_of(batch, path):
                for k, (s, n) in enumerate(tokens.pieces(len(ids), capacity)):
                    held.append((ids_of[row], k, s, ids[s:s + n].astype(np.uint16 if id_bytes == 2 else np.uint32)))
                    size += n
                if size >= buffer:
                    yield from flush()
        yield from flush()
    return run


def packed_rows(docs: DataFrame, capacity: int = CAPACITY, buffer: int = BUFFER, id_bytes: int = ID_BYTES,
                path: str | None = None) -> DataFrame:
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(_packer(capacity, buffer, id_bytes, path), SCHEMA)


def write_packed(docs: DataFrame, out: str, **options) -> None:
    """The packed rows as Parquet files of a folder that all executors share."""
    packed_rows(docs, **options).write.parquet(out)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(documents(spark, sf_dir))

"""Helpers shared by the training-data operators: tables, columns, written steps."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.kernel import column_bytes
from cadenza.session import materialize, work_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# word separators of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_text(table(spark, sf_dir, "documents"))


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator reads, so extra or clashing columns of
    the caller never meet its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "cadenza.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "cadenza")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Before Python tasks: ship the package, and bound the rows and bytes of an
    Arrow batch, so that long texts don't fill a task's memory."""
    work_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return a worker's freed memory to the system: it may idle in the pool for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:                     # another C library
        pass


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches, whose workers give memory back at the end of a task."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps start from files."""
    return materialize(df, name)


def ascii_lower(col):
    """Lower-case A-Z only (``lower`` would fold other alphabets too)."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(col, n: int):
    """crc32 of the id written as text, modulo ``n`` (NULL for a NULL id)."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % n


def carried(docs: DataFrame):
    """All columns but the text as one struct, for steps that rebuild the rows."""
    return F.struct(*[F.col(c) for c in docs.columns if c != "text"])


FILTER_BITS = 1 << 26           # of an id filter: 8 MB on the driver and on every executor


def _filter_positions(col):
    """Two places of a value in an id filter."""
    return [F.pmod(h, F.lit(FILTER_BITS)).alias(f"at{i}") for i, h in enumerate((F.xxhash64(col), F.xxhash64(col, F.lit(1))))]


def bit_filter(places: DataFrame, size: int) -> np.ndarray:
    """``size`` bits as bytes, with a bit set for every value of the column ``at``
    (from 0); built by Spark, ``size`` / 8 bytes on the driver."""
    one = F.col("at") + 1                                     # the bitmap functions count from 1
    maps = places.groupBy(F.bitmap_bucket_number(one).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for row in maps.toLocalIterator():
        own = np.frombuffer(row.bits, np.uint8)
        bits[(row.part - 1) * len(own):row.part * len(own)] = own
    return bits


def _pack_column(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its texts compressed one by one as the last column, ``packed``."""
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    data, offs = column_bytes(batch.column("text"))
    raw, at = memoryview(np.ascontiguousarray(data)), offs.tolist()
    packed = [c.compress(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
    names = [n for n in batch.schema.names if n != "text"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(packed, pa.binary())], [*names, "packed"])


def packed(df: DataFrame) -> DataFrame:
    """``df`` with its column ``text`` compressed as ``packed`` (NULL as empty), for
    steps that must shuffle whole texts."""
    def run(batches):
        yield from map(_pack_column, batches)

    return map_arrow(df, run, ", ".join([f"{n} {t}" for n, t in df.dtypes if n != "text"] + ["packed binary"]))


def packed_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the rows whose doc_id may be in ``ids`` (a Bloom filter of
    fixed size, so a few others may stay; an exact semi join follows). It keeps texts
    nobody wants out of that join's shuffle. One Python task filters and packs."""
    bit = ids.select(F.explode(F.array(*_filter_positions(F.col("doc_id")))).alias("at"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(bit, FILTER_BITS))

    def run(batches):
        held = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for name in ("at0", "at1"):
                at = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                keep &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield _pack_column(batch.select(["doc_id", "text"]).filter(pa.array(keep)))

    placed = id_text(docs).where("doc_id IS NOT NULL")
    return map_arrow(placed.select("doc_id", "text", *_filter_positions(F.col("doc_id"))), run, "doc_id long, packed binary")


def packed_texts(docs: DataFrame, rest: bool = False) -> DataFrame:
    """(doc_id, packed) of every document; with ``rest``, also all other columns as a struct."""
    own = id_text(docs)
    if rest:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried(docs).alias("rest"))
    return packed(own)


@functools.cache
def _decompressor():
    """One a worker: a new one for every text costs more than most texts."""
    import zstandard

    return zstandard.ZstdDecompressor()


def unpack_bytes(value: bytes) -> bytes:
    return _decompressor().decompress(value)


def unpack(value: bytes) -> str:
    return unpack_bytes(value).decode()

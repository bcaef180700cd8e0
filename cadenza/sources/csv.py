"""CSV sources and sinks."""

from __future__ import annotations

import re
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.text import missing_marker_to_null
from cadenza.operators.clean import normalise_nan
from cadenza.schema import POSITION

_CORRUPT = "_corrupt"
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _texts(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, prune: bool = True) -> DataFrame:
    """Every column as text under its name in the header; ``_corrupt`` holds a
    row with another number of fields (unless ``prune`` skips unread columns). Raises if a column of ``schema`` is
    absent, or if the files of a folder have different headers."""
    def reader():
        return spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    names = reader().csv(path).columns
    absent = [f.name for f in schema if f.name not in names]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)}; the header has {', '.join(names)}")
    unnamed = any(re.fullmatch(r"_c\d+", c) for c in names)     # such headers can't be compared by name
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _CORRUPT]])
    return (reader().schema(texts).option("enforceSchema", unnamed).option("mode", "PERMISSIVE")
            .option("columnPruning", prune).option("columnNameOfCorruptRecord", _CORRUPT).csv(path))


def _typed(name: str, kind: str) -> Column:
    """The text as ``kind``; NULL where it is missing or can't be read as such."""
    text = missing_marker_to_null(name)
    if kind == "string":
        return text
    if kind in _WHOLE:      # "1.0" is a whole number too
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType,
             multi_line: bool = False, positions: bool = False) -> DataFrame:
    """Read the columns of ``schema`` from a headed CSV, by name.

    Columns may stand in any order and others beside them are left out; an
    absent one raises. Quoted fields use doubled quotes (``""``). Every text a
    CSV reader treats as missing (``NA``, ``None``, ``null`` ...) becomes NULL,
    NaN too, and so does what can't be read as the column's type:
    :func:`bad_values` counts those.

    Files are split by byte ranges. ``multi_line`` is for quoted fields with
    line breaks; a file then is one task, so give a large input as many files.
    ``positions`` adds the columns ``schema.POSITION``, which order rows as they
    stand in the files.
    """
    df = _texts(spark, path, schema, multi_line)
    at = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    df = df.select(*[_typed(f.name, f.dataType.simpleString()).alias(f.name) for f in schema],
                   *[c.alias(name) for c, name in zip(at, POSITION, strict=True) if positions])
    return normalise_nan(df)


def bad_values(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """(column, n_missing, n_bad) of each column of ``schema``: values that are
    missing, and texts that can't be read as its type. The row with a NULL column
    has in ``n_bad`` the rows with more or fewer fields than the header."""
    df = _texts(spark, path, schema, multi_line, prune=False)
    counts = []
    for f in schema:
        text = missing_marker_to_null(f.name)
        bad = text.isNotNull() & _typed(f.name, f.dataType.simpleString()).isNull()
        counts.append(F.struct(F.lit(f.name).alias("column"), F.count_if(text.isNull()).alias("n_missing"),
                               F.count_if(bad).alias("n_bad")))
    counts.append(F.struct(F.lit(None).cast("string").alias("column"), F.lit(0).cast("bigint").alias("n_missing"),
                           F.count(_CORRUPT).alias("n_bad")))
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def stage_url(url: str, target_dir: str, spark: SparkSession | None = None) -> str:
    """Copy a CSV from HTTP(S) once, in chunks, to a folder of any file
    system that Spark writes (a shared one on a cluster), to be read with
    :func:`scan_csv`; executors never fetch the URL themselves."""
    sc = (spark or SparkSession.getActiveSession()).sparkContext
    target = f"{target_dir.rstrip('/')}/{url.split('?')[0].rstrip('/').rsplit('/', 1)[-1] or 'data.csv'}"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    with urllib.request.urlopen(url) as src:  # noqa: S310
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        try:
            while chunk := src.read(1 << 20):
                out.write(chunk)
        finally:
            out.close()
    return target


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Write a view as headed CSV, a file per partition; ``single_file`` is
    for small views that are wanted in one file."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", True).csv(path))

"""Session construction and the shared work folder.

On a cluster the work folder is the one the cluster names in
``spark.checkpoint.dir`` (a shared file system). Only when that is unset, as in
local tests, a scratch folder is created and registered as checkpoint dir.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings the library relies on (AQE for runtime re-planning and skew
# splitting, UTC so that timestamps agree with other engines).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "cadenza",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_dir(spark)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Reads the folder the cluster configured; sets a scratch one only when none
    is configured (local runs and tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cadenza-ckpt-", dir="/tmp"))
    else:
        # executors cannot share a machine-local folder with the driver
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store, shared mount)")
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give this package's sources to the executors' Python workers, once per application,
    also when several threads ask."""
    with _SHIPPING:
        _ship(spark)


def _ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "cadenza.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "cadenza")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared work folder."""
    base = work_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared work folder and read it back.

    Cuts the lineage (a lost executor only re-reads the written files) and
    lets later passes prune columns at the scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


ROWS_A_PARTITION = 250_000


@contextmanager
def shuffles_for(spark: SparkSession, rows: int):
    """Shuffles of at most about ``ROWS_A_PARTITION`` rows a partition (or as many
    partitions as the session has, if that is more) while a large table is
    written, whatever the session's setting: tasks then sort in memory at any
    size. AQE joins small partitions up to 16 MB and may split a skewed join at the
    price of one more shuffle."""
    sized = {
        "spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PARTITION))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    before = {k: spark.conf.get(k, None) for k in sized}
    try:
        for k, v in sized.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme, for helpers that need a plain local path."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def sized_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Partitioning settings for a given input size and cluster.

    Scan splits of ``target_partition_bytes`` and enough shuffle partitions
    that each holds about that much (at least two waves of tasks); AQE then
    coalesces small ones and splits skewed ones at run time. For 100 TB on
    1000 executors x 8 cores this gives ~400k shuffle partitions of ~256 MB.
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
    }

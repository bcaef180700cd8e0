"""Centroid clustering by a progressive search over Walsh-Hadamard coefficients.

Vectors are whole numbers, and so is their Walsh-Hadamard transform; with 64
components the squared distance of two transforms is exactly 64 times that of the
vectors. Coefficients are ordered by their number of sign changes. The search adds
squared coefficient differences block by block, 1, 1, 2, 4, 8, 16 and 32 of them:
after each block the most promising centroid of a vector is finished to bound its
distance, and centroids whose partial sum is strictly over the bound go. Those
that are left at the end have all 64 coefficients, so distances and ties are exact.

Each round reads the written vectors, sums them by cluster inside every task and
brings one row a cluster to the driver (``k`` rows). Assignment needs nothing but
the vector and the ``k`` centroids, so no cluster of any size is ever gathered.

Edge cases: vectors that are NULL, of another length, or hold a NULL, NaN or
infinite component are left out. A NULL vec_id is kept (its hash is that of the
bare prefix). Repeated rows are vectors of their own; equal hashes start in order
of their components. Fewer than ``k`` vectors make fewer centroids; an empty table
gives no rows. Components whose scaled value is 2**22 or more go through Python's
whole numbers; a distance or sum past 64 bits raises, it never wraps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import map_arrow, table, written

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = "2:"
_EXACT = 1 << 22                      # below, sums of squared coefficients fit 64 bits


def _sequency(n: int) -> np.ndarray:
    """Places of the transform in order of the sign changes of their function."""
    h = np.array([[1]])
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")


_ORDER = _sequency(DIMENSIONS)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of every row, coarse ones first."""
    n = len(x)
    step = 1
    while step < DIMENSIONS:
        pair = x.reshape(n, -1, 2, step)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2).reshape(n, DIMENSIONS)
        step *= 2
    return x[:, _ORDER]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row."""
    n, k = len(x), len(centroids)
    if n == 0 or k == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(np.abs(x).max(), np.abs(centroids).max()) >= _EXACT:
        x, centroids = x.astype(object), centroids.astype(object)
    tx, tc = transform(x), transform(centroids)
    row, cen = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)      # sorted by row, then centroid
    part = np.zeros(n * k, tx.dtype)
    bound, begin = None, 0
    while begin < DIMENSIONS:
        end = max(1, 2 * begin)
        part = part + ((tx[row, begin:end] - tc[cen, begin:end]) ** 2).sum(1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(part, first)
        hit = np.flatnonzero(part == least[row])                         # every row has candidates
        hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]         # the first of each row
        full = part[hit] + ((tx[:, end:] - tc[cen[hit], end:]) ** 2).sum(1)
        bound = full if bound is None else np.minimum(bound, full)
        keep = (part <= bound[row]).astype(bool)
        if end == DIMENSIONS:
            return cen[hit], part[hit] // DIMENSIONS
        row, cen, part = row[keep], cen[keep], part[keep]
        begin = end
    raise AssertionError("unreachable")


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(len(col), DIMENSIONS)


def _quantise(scale: int):
    def run(batches):
        for batch in batches:
            x = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(x) and np.abs(x).max() >= 1 << 62:
                raise OverflowError("a scaled component doesn't fit 64 bits")
            offs = pa.array(np.arange(len(batch) + 1) * DIMENSIONS, pa.int32())
            q = pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), q], ["vec_id", "q"])
    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the vectors that count, as whole numbers."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return map_arrow(v.where((F.size("v") == DIMENSIONS) & whole), _quantise(scale), "vec_id long, q array<long>")


def _sums(centroids: np.ndarray):
    """(cluster, n, sums) of a task's vectors."""
    def run(batches):
        k = len(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), object)
        for batch in batches:
            x = _matrix(batch.column("q"))
            cluster, _ = nearest(x, centroids)
            n += np.bincount(cluster, minlength=k)
            small = len(x) == 0 or np.abs(x).max() < 1 << 40
            for c in np.unique(cluster):
                own = x[cluster == c]
                sums[c] += (own if small else own.astype(object)).sum(0).astype(object)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array([list(s) for s in sums[some]], pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])
    return run


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column("q")), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(list(distance), pa.int64())],
                                             ["vec_id", "cluster", "distance"])
    return run


def first_centroids(q: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id."""
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = q.select(hashed.alias("h"), "q").orderBy("h", "q").limit(k).collect()       # k rows
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that counts, the centroids)."""
    q = written(quantised(vectors, scale), "vectors")
    centroids = first_centroids(q, k, seed)
    total = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(DIMENSIONS)]
    for _ in range(rounds):
        found = map_arrow(q.select("q"), _sums(centroids), "cluster int, n long, sums array<long>")
        centroids = centroids.copy()
        for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # k rows
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(DIMENSIONS)]
    return map_arrow(q, _assign(centroids), "vec_id long, cluster int, distance long"), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"))


def report(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(vectors, k, rounds, scale, seed)
    found = written(found, "vector-clusters")
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}      # k rows
    about = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    about = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same rounds as common table expressions; one a round."""
    start = (f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
             f" WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),"
             f" parts AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM kept),"
             f" c0 AS (SELECT q, row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS cluster FROM kept"
             f" QUALIFY cluster < {CENTROIDS}),")
    near = ("a{0} AS (SELECT vec_id, min(struct_pack(d := d, cluster := cluster)) AS best FROM (SELECT vec_id, cluster, CAST(list_sum(list_transform("
            "list_zip(kept.q, c{0}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{0}) GROUP BY vec_id)")
    mean = (", c{1} AS (SELECT coalesce(m.q, c{0}.q) AS q, c{0}.cluster FROM c{0} LEFT JOIN (SELECT cluster, list(s ORDER BY i) AS q FROM ("
            "SELECT best.cluster AS cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS s FROM parts JOIN a{0} USING (vec_id) GROUP BY 1, 2) GROUP BY 1) m"
            " USING (cluster)), ")
    rounds = "".join(near.format(r) + (mean.format(r, r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    return (f"WITH {start} {rounds} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, best.d AS distance,"
            " CAST(sum(best.d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,"
            f" sha256(array_to_string(q, ',')) AS centroid_sha256 FROM (SELECT *, best.cluster AS cluster FROM a{ROUNDS}) JOIN c{ROUNDS} USING (cluster)")


ORACLE = _oracle()

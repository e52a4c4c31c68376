"""Centroid clustering with weighted deduplication: Lloyd's rounds over the different vectors, each with its multiplicity.

Components become whole numbers, equal vectors are grouped and counted, and each round goes over the groups only: a task sends one row of exact
weighted sums for each centroid, which Spark adds up, so that the driver gets as many rows as there are centroids. At the end the groups' clusters
are joined back to the vec_ids; groups that hold much of all rows are broadcast (common.spread_join).

Vectors with another number of components, or with one that is null, NaN, infinite or of 131,072 or more in size (whose squared distances need more than 64 bits),
are left out. Repeated rows are vectors of their own. A vec_id may be null or repeated: a null one never starts a centroid, and of
equal ones the smaller vector comes first. Fewer vectors than centroids make fewer centroids; no vectors give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common

#: Components of a vector, steps of one unit, centroids, rounds: fixed values.
WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: Components are smaller than this, so that WIDTH squared differences fit into 64 bits.
LARGEST = 131_072
#: Vectors that numpy takes at a time.
AT_ONCE = 8192


def quantised(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector array<int>) of the vectors that are kept."""
    raw = vectors.select(vectors["vec_id"].alias("vec_id"), vectors["embedding"].cast("array<double>").alias("raw"))
    whole = F.forall("raw", lambda x: x.isNotNull() & (F.abs(x) < LARGEST * 1024 // scale))  # false for NaN, which is above all numbers
    kept = raw.where(F.col("raw").isNotNull() & (F.size("raw") == width) & F.coalesce(whole, F.lit(False)))
    return kept.select("vec_id", F.transform("raw", lambda x: F.floor(x * float(scale)).cast("int")).alias("vector"))


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield part, part.column("vector").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; the smaller number of equally near ones."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(x)), k]


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch, x in _chunks(batches, centroids.shape[1]):
            weight = batch.column("weight").to_numpy()
            k, _ = nearest(x, centroids)
            for c in np.unique(k).tolist():
                own = k == c
                n[c] += weight[own].sum()
                total[c] += (x[own] * weight[own, None]).sum(axis=0)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), pa.array(total[full].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _chunks(batches, centroids.shape[1]):
            k, d = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("weight"), pa.array(k, pa.int32()), pa.array(d)], names=["vector", "weight", "cluster", "distance"])

    return run


def moved(groups: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; those without a vector stay."""
    width = centroids.shape[1]
    parts = groups.transform(common.in_arrow, _sums(centroids), "cluster int, n long, sums array<long>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()
    new = centroids.copy()
    for r in found:  # one for each centroid
        new[r.cluster] = [s // r.n for s in r.sums]
    return new


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, width: int = WIDTH) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    rows = quantised(vectors, width)
    groups = common.written(rows.groupBy("vector").agg(F.count("*").alias("weight")), "vectors")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select("vector", by_hash.alias("h")).orderBy("h", "vector").limit(centroids).collect()
    if not first:  # no vector, or none with an id
        return rows.where("vec_id is not null").selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256").limit(0)
    c = np.array([r.vector for r in first], np.int64)
    for _ in range(rounds):
        c = moved(groups, c)
    final = common.written(groups.transform(common.in_arrow, _assign(c), "vector array<int>, weight long, cluster int, distance long"), "assigned")
    exact = "decimal(38,0)"
    sums = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast(exact) * F.col("weight")).cast(exact).alias("s")).collect()}  # one for each centroid
    total = int(final.agg(F.sum("weight")).first()[0])
    told = [(k, sums.get(k, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for k, row in enumerate(c.tolist())]
    told = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return common.spread_join(rows, final, ["vector"], "weight", total).join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

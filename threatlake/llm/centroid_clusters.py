"""Centroid clustering in integers, with a filter of PCA-rotated coordinates.

Components are integers, ``floor(256 * x)``; distances are squared Euclidean distances of integers, so that any machine and any
partitioning gives the same clusters.

* *Rotation.* One pass sums the moments of all vectors; the eigenvectors of their covariance give an orthonormal basis. Each vector
  is stored with its leading LEAD coordinates there and the norm of all the others, the residual.
* *Filter.* For a vector and a centroid, the squared distance of the leading coordinates plus the squared difference of the two
  residual norms is never above their squared distance. The centroid with the least bound is measured first, then only those
  whose bound is not above the best distance found: the survivors. They are measured in integers, ties go to the smaller number.
* *Rounds.* Each round is one pass over the stored vectors: a task returns a row of sums per cluster, Spark adds them up, and the
  driver gets one row per cluster. Centroids are broadcast: ``k`` times 64 integers, whatever the number of vectors.

Defined cases: vectors that are null, have another length, or hold null or non-finite components take no part, nor do those with
a component of 2**27 or more, whose distances don't fit a long; a null ``vec_id`` is clustered but starts no centroid;
rows that repeat a ``vec_id`` are clustered each, and compete as starting centroids by their components; with fewer than ``k``
vectors there are fewer centroids; equal centroids leave the ones with larger numbers empty, and empty ones stay where they are; other columns are
ignored; no vectors give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import scratch, stored

SCALE, DIM, LIMIT = 256, 64, 1 << 27
LEAD = 12
#: Allowance for rounding in the bounds, a part of the squared lengths; it only ever adds survivors.
SLACK = 1e-9


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector): the vectors that take part, as little-endian 64-bit integers."""
    for batch in batches:
        column = batch.column("embedding")
        ends = column.offsets.to_numpy()
        keep = np.flatnonzero(np.diff(ends) == DIM)
        flat = column.values
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        at = ends[:-1][keep][:, None] + np.arange(DIM)
        scaled = np.floor(np.where(np.isfinite(values), values, 0) * SCALE)
        good = ~((bad | ~np.isfinite(values))[at].any(1) | (np.abs(scaled[at]) >= LIMIT).any(1))
        rows = scaled[at[good]].astype("<i8")
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(keep[good])), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "vector"]
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, DIM)


# --- rotation ---------------------------------------------------------------------------------------------------------


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, value): the number of vectors, their sums, and the sums of products, one set for each task."""
    total = np.zeros(1 + DIM + DIM * DIM)
    for batch in batches:
        x = _matrix(batch.column("vector")).astype(np.float64)
        total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])


def rotation(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthonormal basis, directions of large variance first. Its entries are sums over all vectors."""
    sums = vectors.mapInArrow(_moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(1 + DIM + DIM * DIM)
    for place, value in sums.collect():
        total[place] = value
    n = max(total[0], 1.0)
    mean = total[1 : 1 + DIM] / n
    spread = total[1 + DIM :].reshape(DIM, DIM) / n - np.outer(mean, mean)
    _, basis = np.linalg.eigh((spread + spread.T) / 2)
    return mean, basis[:, ::-1].copy()


def rotated(x: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the others."""
    y = (x - mean) @ basis
    return y[:, :LEAD], np.sqrt((y[:, LEAD:] ** 2).sum(1))


def _rotate(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    mean, basis = model.value
    for batch in batches:
        lead, rest = rotated(_matrix(batch.column("vector")), mean, basis)
        packed = pa.array([r.tobytes() for r in np.ascontiguousarray(lead)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(rest)], ["vec_id", "vector", "lead", "rest"])


# --- assignment -------------------------------------------------------------------------------------------------------


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray):
    """(cluster, squared distance, measured): the nearest centroid of each row of ``x``, and how many were measured for it."""
    low = np.zeros((len(x), len(centroids)))
    for j in range(len(centroids)):
        low[:, j] = ((lead - c_lead[j]) ** 2).sum(1) + (rest - c_rest[j]) ** 2
    size = (lead**2).sum(1) + rest**2
    low -= SLACK * (size[:, None] + (c_lead**2).sum(1) + c_rest**2) + 1e-6
    cluster = low.argmin(1)
    best = ((x - centroids[cluster]) ** 2).sum(1)
    measured = np.ones(len(x), np.int64)
    first = cluster.copy()
    for j in range(len(centroids)):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        measured[rows] += 1
        distance = ((x[rows] - centroids[j]) ** 2).sum(1)
        better = (distance < best[rows]) | ((distance == best[rows]) & (j < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = distance[better], j
    return cluster, best, measured


def _assigned(batch: pa.RecordBatch, model):
    centroids, lead, rest = model.value
    x = _matrix(batch.column("vector"))
    own = np.frombuffer(b"".join(batch.column("lead").to_pylist())).reshape(len(x), -1)
    return x, *nearest(x, own, batch.column("rest").to_numpy(), centroids, lead, rest)


def _sums(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(cluster, n, s0, s1, ...): a row for each cluster of a task."""
    k = len(model.value[0])
    count, total = np.zeros(k, np.int64), np.zeros((k, DIM), np.int64)
    for batch in batches:
        if batch.num_rows:
            x, cluster, _, _ = _assigned(batch, model)
            count += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                total[j] += x[cluster == j].sum(0)
    some = np.flatnonzero(count)
    columns = [pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, j]) for j in range(DIM))]
    yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *(f"s{j}" for j in range(DIM))])


def _final(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, cluster, distance, _ = _assigned(batch, model)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
        )


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of their ids, in that order."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(key, "vector").limit(k).select("vector").collect()
    return np.array([np.frombuffer(r.vector, np.int64) for r in rows], np.int64).reshape(-1, DIM)


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    with scratch(embeddings.sparkSession):
        return _cluster(embeddings, k, rounds)


def _cluster(embeddings: DataFrame, k: int, rounds: int) -> DataFrame:
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding IS NOT NULL")
    rows = stored(rows.mapInArrow(_fixed, "vec_id long, vector binary"), "fixed")
    mean, basis = rotation(rows)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], names)
    turn = spark.sparkContext.broadcast((mean, basis))
    rows = stored(rows.mapInArrow(partial(_rotate, model=turn), "vec_id long, vector binary, lead binary, rest double"), "rotated")
    sums = "cluster int, n long, " + ", ".join(f"s{j} long" for j in range(DIM))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((centroids, *rotated(centroids, mean, basis)))
        found = rows.mapInArrow(partial(_sums, model=model), sums).groupBy("cluster").agg(
            F.sum("n").alias("n"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(DIM))
        )
        centroids = centroids.copy()
        for number, n, *total in found.collect():
            centroids[number] = [s // n for s in total]
    model = spark.sparkContext.broadcast((centroids, *rotated(centroids, mean, basis)))
    out = stored(rows.mapInArrow(partial(_final, model=model), "vec_id long, cluster int, distance long"), "clusters", lasting=True)
    inertia = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    about = [
        (number, inertia[number], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[number].tolist())).encode()).hexdigest())
        for number in sorted(inertia)
    ]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Exact search for the largest inner products by a pivot-distance index.

Components are integers, ``floor(64 * x)``, and so are scores. One more coordinate, sqrt(M - |x|^2) with M the largest
squared length, puts all vectors on a sphere: there a larger inner product with a query is a smaller distance to it, and the
triangle inequality bounds it from distances to a pivot.

* *Classes.* Equal vectors have equal scores, and of them only the k + 1 with the smallest ids can be among the best k of any query: these
  are the candidates. Equal queries are asked once, for k + 1, and each of them gets the result without itself. So a vector with a third of all
  ids costs as much as any other.
* *Index.* Pivots come from a bounded sample. Each candidate is keyed by its nearest pivot and its distance to it; sorted by
  that key they are cut into blocks of BLOCK, each a part of an annulus around a pivot.
* *Search.* A query's own block gives a first k-th best score. That score is a distance within which all better vectors
  lie, hence, for every pivot, a range of distances: the annuli it has to be expanded to. Query and blocks meet in an equi-join on the pivot
  with that range; blocks outside can't hold a better vector. Each block scores its queries at once, and
  the best k per block and query are merged.

All vectors are indexed and all bounds are exact, so results are those of brute force. Queries meet a block in
groups of at most about QUERIES.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part; vectors of different
lengths don't meet; rows that repeat a ``vec_id`` count once, by the smallest of them; a null ``vec_id`` takes no part;
with fewer than k candidates all are returned; other columns are ignored; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatlake.llm.common import part_count, stored

SCALE = 64
BLOCK, QUERIES = 1024, 4096
SAMPLE, PIVOTS, ROUNDS = 4096, 48, 4
#: Allowance for rounding in distances, relative and absolute; it only ever widens an annulus.
SLACK = 1e-9


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, norm, vector, query): vectors that take part, as little-endian 64-bit integers."""
    for batch in batches:
        column = batch.column("embedding")
        ends = column.offsets.to_numpy()
        flat = column.values
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        bad |= ~np.isfinite(values)
        fixed = np.floor(np.where(bad, 0, values) * SCALE).astype(np.int64)
        worse = np.concatenate([[0], np.cumsum(bad)])
        keep = np.flatnonzero((worse[ends[1:]] == worse[ends[:-1]]) & (np.diff(ends) > 0))
        parts = [fixed[ends[i] : ends[i + 1]] for i in keep]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").take(pa.array(keep)), pa.array([len(p) for p in parts], pa.int32()),
                pa.array([float(p.astype(float) @ p) for p in parts], pa.float64()), pa.array([p.tobytes() for p in parts], pa.binary()),
                batch.column("query").take(pa.array(keep)),
            ],
            ["vec_id", "dim", "norm", "vector", "query"],
        )


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.int64).reshape(len(vectors), -1)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, square))


def choose_pivots(sample: np.ndarray, top: float) -> np.ndarray:
    """Centres of the sample: spread over it first, then moved to the means of what is nearest to them."""
    x = np.unique(_lifted(sample, top), axis=0)
    centres, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(centres) < min(PIVOTS, len(x)):
        centres.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[centres[-1]]) ** 2).sum(1))
    pivots = x[centres]
    for _ in range(ROUNDS):
        near = _distances(x, pivots).argmin(1)
        pivots = np.array([x[near == i].mean(0) if (near == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def _key(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Add each vector's nearest pivot and its distance."""
    pivots, top = model.value
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        pivot, distance = np.zeros(len(dims), np.int32), np.zeros(len(dims))
        vectors = batch.column("vector").to_pylist()
        for d in np.unique(dims).tolist():
            of = np.flatnonzero(dims == d)
            all_ = _distances(_lifted(_matrix([vectors[i] for i in of]), top[d]), pivots[d])
            pivot[of], distance[of] = all_.argmin(1), all_.min(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(distance)], [*batch.schema.names, "pivot", "distance"])


BLOCKS = "block long, dim int, pivot int, low double, high double, ids binary, queries binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the sorted vectors as blocks."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        nonlocal number, held
        number += 1
        ids, queries = np.array([r[3] for r in held], np.int64), np.array([r[4] for r in held], bool)
        row = [number, held[0][0], held[0][1], held[0][2], held[-1][2], ids.tobytes(), queries.tobytes(), b"".join(r[5] for r in held)]
        held = []
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("dim", "pivot", "distance", "vec_id", "query", "vector"))):
            if held and (len(held) >= BLOCK or held[0][:2] != row[:2]):
                yield block()
            held.append(row)
    if held:
        yield block()


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _begin(batches: Iterator[pa.RecordBatch], model, k: int) -> Iterator[pa.RecordBatch]:
    """For each query its k-th best score in its own block, and per pivot the range of distances that may hold as good."""
    pivots, top = model.value
    names = ["query_id", "dim", "vector", "least", "low", "high"]
    for batch in batches:
        for row in batch.to_pylist():
            ids, queries = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["queries"], bool)
            if not queries.any():
                continue
            d = row["dim"]
            x = np.frombuffer(row["vectors"], np.int64).reshape(-1, d)
            q = x[queries]
            least = np.full(len(q), -np.inf)
            if len(x) >= k:
                least = np.partition(_scores(q, x).astype(np.float64), -k, axis=1)[:, -k]
            flat = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
            room = np.maximum(0, (flat * flat).sum(1) + top[d] - 2 * least)
            radius = np.sqrt(room) * (1 + SLACK) + SLACK * np.sqrt(top[d]) + 1e-6
            away = _distances(flat, pivots[d])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[queries]), pa.array(np.full(len(q), d, np.int32)), pa.array([v.tobytes() for v in q], pa.binary()),
                    pa.array(least), pa.array((away - radius[:, None]).tolist(), pa.list_(pa.float64())),
                    pa.array((away + radius[:, None]).tolist(), pa.list_(pa.float64())),
                ],
                names,
            )


def _best(k: int):
    def merge(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        """(query_id, vec_id, score): the best k of a block for each query that reaches it."""
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and blocks.num_rows:
            q = _matrix(queries.column("vector").to_pylist())
            asked, least = queries.column("query_id").to_numpy(), queries.column("least").to_numpy()
            row = blocks.to_pylist()[0]
            ids = np.frombuffer(row["ids"], np.int64)
            x = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1)
            for at in range(0, len(q), 512):
                scores = _scores(q[at : at + 512], x)
                for i, line in enumerate(scores):
                    good = np.flatnonzero(line >= least[at + i])
                    good = good[np.lexsort((ids[good], -line[good]))[:k]]
                    out[0].append(np.full(len(good), asked[at + i]))
                    out[1].append(ids[good])
                    out[2].append(line[good])
        columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out]
        return pa.table(columns, ["query_id", "vec_id", "score"])

    return merge


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """Of each vector the ``k`` rows with the smallest ids, first among a part of its rows, then among what those leave."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(part_count(rows.sparkSession)))
    first = F.row_number().over(W.partitionBy("dim", "vector", part).orderBy("vec_id"))
    rest = rows.withColumn("_n", first).where(F.col("_n") <= k)
    last = F.row_number().over(W.partitionBy("dim", "vector").orderBy("vec_id"))
    return rest.withColumn("_n", last).where(F.col("_n") <= k).drop("_n")


def _sample(rows: DataFrame, dim: int) -> np.ndarray:
    """At most SAMPLE vectors of this length, by a hash of their ids; only the ids are sorted."""
    ids = rows.where(F.col("dim") == dim).select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    some = rows.join(F.broadcast(ids), "vec_id", "left_semi").orderBy("vec_id").select("vector").collect()
    return _matrix([bytes(r.vector) for r in some])


def build_index(vectors: DataFrame, query: Column, k: int) -> tuple[DataFrame, object, DataFrame]:
    """(blocks, broadcast model, ``query_id, asked``) over ``vectors(vec_id, embedding)``; ``query`` marks the rows to be searched for,
    and ``asked`` is the query that stands for them in the blocks."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("query", F.coalesce(query, F.lit(False)))
    rows = stored(rows.mapInArrow(_valid, "vec_id long, dim int, norm double, vector binary, query boolean"), "vectors")
    asked = rows.where("query").groupBy("dim", "vector").agg(F.min("vec_id").alias("asked"))
    queries = rows.where("query").select("dim", "vector", F.col("vec_id").alias("query_id")).join(asked, ["dim", "vector"])
    queries = stored(queries.select("query_id", "asked"), "asked", lasting=True)
    ones = stored(queries.select(F.col("asked").alias("_one")).distinct(), "ones")
    candidates = _smallest(rows, k).withColumn("_kept", F.lit(True))
    either = candidates.drop("query").unionByName(rows.drop("query").join(ones, F.col("vec_id") == F.col("_one"), "left_semi").withColumn("_kept", F.lit(False)))
    either = either.groupBy("vec_id", "dim", "norm", "vector").agg((~F.min("_kept")).alias("query"))
    rows = stored(either.select("vec_id", "dim", "norm", "vector", "query"), "candidates")
    tops = {r.dim: r.top for r in rows.groupBy("dim").agg(F.max("norm").alias("top")).collect()}
    model = spark.sparkContext.broadcast(({d: choose_pivots(_sample(rows, d), tops[d]) for d in sorted(tops)}, tops))
    keyed = rows.drop("norm").mapInArrow(partial(_key, model=model), "vec_id long, dim int, vector binary, query boolean, pivot int, distance double")
    order_by = ["dim", "pivot", "distance", "vec_id"]
    blocks = keyed.repartitionByRange(*order_by).sortWithinPartitions(*order_by).mapInArrow(_pack, BLOCKS)
    return stored(blocks, "annuli", lasting=True), model, queries


def search(vectors: DataFrame, query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every row marked by ``query`` with all others."""
    blocks, model, queries = build_index(vectors, query, k + 1)
    begun = blocks.mapInArrow(
        partial(_begin, model=model, k=k + 1), "query_id long, dim int, vector binary, least double, low array<double>, high array<double>"
    )
    begun = stored(begun, "queries")
    groups = max(1, -(-begun.count() // QUERIES))
    annuli = begun.select("query_id", "dim", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "_a"))
    annuli = annuli.select("query_id", "dim", "pivot", F.col("_a.low").alias("_from"), F.col("_a.high").alias("_to"))
    reach = annuli.join(blocks.select(F.col("block").alias("cell"), "dim", "pivot", "low", "high"), ["dim", "pivot"])
    reach = reach.where((F.col("low") <= F.col("_to")) & (F.col("high") >= F.col("_from"))).select("query_id", "cell")
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")
    asked = reach.join(begun.select("query_id", "vector", "least"), "query_id").select("cell", group, "query_id", "vector", "least")
    there = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "ids", "vectors")
    found = asked.groupBy("cell", "part").cogroup(there.groupBy("block", "part")).applyInArrow(
        _best(k + 1), "query_id long, vec_id long, score long"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).drop("rank").withColumnRenamed("query_id", "asked")
    each = queries.join(found, "asked").where(F.col("vec_id") != F.col("query_id"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

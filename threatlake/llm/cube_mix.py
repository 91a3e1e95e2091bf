"""Mixing sources to target weights by the cube method.

Each source has a target in words. All its documents are taken ``floor(target / size of the source)`` times, and the
fraction that remains is their inclusion probability for one more time. The cube method draws that sample: starting from
the vector of probabilities it moves along directions in the null space of the constraints, which keep the expected
words and the number of documents as they are, until a coordinate becomes 0 or 1; so nearly all coordinates are
decided with both totals exact.

The moves run in blocks of bounded size inside each source, so a source with most of the documents is many tasks. A
block leaves at most two documents undecided, as there are two constraints; those of all blocks of a source form the
next, much smaller round. The last round leaves LANDING documents in each source: the landing takes the outcome nearest
to the expected words. Documents are moved in ascending size, so the landing has the largest at its disposal, whose
sums are dense around the expected words.

Randomness comes from a seed and the block alone: reruns agree.

Defined cases: null and blank texts have size 0 and are taken 0 words; null sources are one source, after all
others; a source without words has target 0; rows that repeat a ``doc_id`` are units of their own; other columns of the
input are ignored; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from threatlake.llm.common import stored, text_of

WEIGHTS = (5.0, 2.0, 1.0)
AT_MOST = 3.0
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
SURE = 1e-9
#: Documents of a source that the landing decides together.
LANDING = 12


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, units, target`` of each source of ``sizes(source, size)``. The weights share out all
    words; a target stops at AT_MOST times its source, and what is over goes to the others by weight: in the order of the ratio of
    limit to weight, each source takes its limit as long as that is below its share of what is left."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    totals = totals.withColumn("weight", F.element_at(cycle, (rank % len(WEIGHTS) + 1).cast("int")))
    totals = totals.withColumn("limit", AT_MOST * F.col("source_size"))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = F.sum("source_size").over(W.partitionBy())
    totals = totals.withColumn("_rate", (everything - before) / rest)
    open_rate = F.when(F.col("limit") > F.col("_rate") * F.col("weight"), F.col("_rate"))
    free = F.first(open_rate, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least("limit", F.coalesce(free * F.col("weight"), F.col("limit")))
    return totals.select("source", "source_size", "units", target.alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move probabilities to 0 or 1, three units at a time, with the sums of ``p`` and ``p * size`` unchanged. It ends with
    at most ``leave`` units undecided."""
    undecided = int(((p > SURE) & (p < 1 - SURE)).sum())
    size, p = size.astype(float).tolist(), p.astype(float).tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    active: list[int] = []
    waiting = iter([i for i, x in enumerate(p) if SURE < x < 1 - SURE])
    while undecided > leave:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            move = (c - b, a - c, b - a)
            if not any(move):
                move = (1.0, -1.0, 0.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            move = (1.0, -1.0)
        else:
            break
        ahead = min([(1 - p[i]) / m if m > 0 else -p[i] / m for i, m in zip(active, move) if m])
        back = min([p[i] / m if m > 0 else (p[i] - 1) / m for i, m in zip(active, move) if m])
        step = ahead if next(draws) * (ahead + back) < back else -back
        for i, m in zip(active, move):
            p[i] += step * m
            if p[i] <= SURE or p[i] >= 1 - SURE:
                p[i] = float(p[i] > 0.5)
        undecided -= len(active)
        active = [i for i in active if 0 < p[i] < 1]
        undecided += len(active)
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide the few undecided units: of all outcomes the one whose words come nearest to the expected ones, then
    whose number does."""
    open_ = np.flatnonzero((p > SURE) & (p < 1 - SURE))
    outcomes = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words, number = np.abs((outcomes - p[open_]) @ size[open_]), np.abs((outcomes - p[open_]).sum(1))
    p = np.round(p)
    p[open_] = outcomes[np.lexsort((number, words))[0]]
    return p


def _fly(seed: int, last: bool):
    """The moves of one block; in the ``last`` round the landing too."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "_order", "doc_id"], kind="stable")
        rng = np.random.Generator(np.random.PCG64([seed, int(rows["block"].iloc[0]), len(rows), int(rows["size"].iloc[0])]))
        size = rows["size"].to_numpy()
        p = flight(size, rows["p"].to_numpy(), rng, LANDING if last else 2)
        return rows.assign(p=land(size, p) if last else p)

    return block


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every row of ``docs``."""
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    sizes = stored(sizes, "sizes")
    targets = stored(source_targets(sizes).withColumnRenamed("source", "_source"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumns(
        {"base": F.floor(rate + SURE).cast("long"), "_order": F.xxhash64("doc_id", F.lit(seed))}
    ).withColumn("p", F.when(F.col("size") > 0, F.greatest(rate - F.col("base"), F.lit(0.0))).otherwise(0.0))

    done, open_, most = None, units, targets.agg(F.max("units")).first()[0] or 0
    while True:
        blocks = F.ceil(F.col("units") / BLOCK)
        open_ = open_.withColumn("block", F.pmod("_order", blocks))
        flown = open_.groupBy("source", "block").applyInPandas(_fly(seed, most <= BLOCK), open_.schema)
        flown = stored(flown.drop("block"), "flown")
        decided = flown.where("p = 0 OR p = 1")
        done = decided if done is None else done.unionByName(decided)
        if most <= BLOCK:
            break
        # each block leaves two units at most
        left = 2 * F.ceil(F.col("units") / BLOCK)
        open_ = flown.where("p > 0 AND p < 1").withColumns({"units": left, "_order": F.xxhash64("_order")})
        most = 2 * -(-most // BLOCK)
    copies = (F.col("base") + F.col("p")).cast("long")
    return done.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )

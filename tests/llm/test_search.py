import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.llm import pivot_search

SCHEMA = "vec_id long, embedding array<float>, label int, score long, block int, pivot string"


def brute(rows, k):
    fixed = {}
    for vec_id, e in rows:
        if vec_id is not None and e and all(x is not None and np.isfinite(x) for x in e):
            value = tuple(int(np.floor(64 * float(np.float32(x)))) for x in e)
            fixed[vec_id] = min(fixed.get(vec_id, value), value)
    out = set()
    for q, a in fixed.items():
        if q % 20 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), v) for v, b in fixed.items() if v != q and len(a) == len(b)]
            out |= {(q, i + 1, v, -s) for i, (s, v) in enumerate(sorted(scores)[:k])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, 3, "p") for i, e in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("kind", ["clustered", "hot", "awkward"])
def test_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(pivot_search, "BLOCK", 32)
    monkeypatch.setattr(pivot_search, "PIVOTS", 6)
    monkeypatch.setattr(pivot_search, "QUERIES", 7)
    r = random.Random(5)
    rows = [(i, [r.gauss(i % 4, 0.2) if j == i % 4 else r.gauss(0, 0.3) for j in range(6)]) for i in range(240)]
    if kind == "hot":
        rows = [(i, [0.5] * 6 if i % 3 else e) for i, e in rows]
    if kind == "awkward":
        rows += [(300, None), (320, []), (340, [1.0, None]), (360, [float("nan")] * 6), (380, [float("inf")] * 6), (None, [1.0] * 6)]
        rows += [(400, [0.0] * 6), (420, [1.0, 2.0]), (421, [3.0, -1.0]), (440, [1e6] * 6), (0, [9.0] * 6), (441, [-1e6] * 6)]
    got = {tuple(x) for x in pivot_search.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()}
    assert got == brute(rows, 20)


def test_few_and_no_vectors(spark):
    got = pivot_search.search(table(spark, [(0, [1.0, 2.0]), (1, [2.0, 0.5])]), F.col("vec_id") % 20 == 0, 20).collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 64 * 128 + 128 * 32)]
    assert pivot_search.search(table(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert pivot_search.search(table(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_annuli_leave_out_far_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "PIVOTS", 8)
    monkeypatch.setattr(pivot_search, "BLOCK", 32)
    r = random.Random(6)
    rows = [(i, [8.0 * (j == i % 8) + r.gauss(0, 0.05) for j in range(8)]) for i in range(800)]
    blocks, model, _ = pivot_search.build_index(table(spark, rows), F.col("vec_id") % 20 == 0, 21)
    begun = list(pivot_search._begin(iter(blocks.toArrow().to_batches()), model, 20))
    low, high = begun[0].column("low")[0].as_py(), begun[0].column("high")[0].as_py()
    reached = [b for b in blocks.collect() if b.low <= high[b.pivot] and b.high >= low[b.pivot]]
    assert len(reached) < blocks.count() / 2


def test_copies_cost_no_more_than_their_class(spark):
    r = random.Random(8)
    rows = [(i, [0.5] * 6 if i % 3 else [r.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    blocks, _, queries = pivot_search.build_index(table(spark, rows), F.col("vec_id") % 20 == 0, 6)
    entries = sum(len(np.frombuffer(b.ids, np.int64)) for b in blocks.collect())
    assert entries <= 300 + 6 + 1 and queries.count() == 45
    got = {tuple(x) for x in pivot_search.search(table(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()}
    assert got == brute(rows, 5)

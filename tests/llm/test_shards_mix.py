import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, prose
from threatlake.llm import cube_mix, hilbert_shards
from threatlake.llm.common import text_of


def dimensions():
    return {"source": F.col("source").cast("string"), "magnitude": F.floor(8 * F.log2(F.octet_length(text_of()) + 1)).cast("int")}


def test_hilbert_curve_visits_all_neighbours():
    bits, dims = 3, 3
    points = np.array(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
    index = hilbert_shards.hilbert_index(points, bits)
    assert sorted(index.tolist()) == list(range(1 << bits * dims))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_keep_their_law(spark):
    rows = [(i, prose(i, 5 + i % 40), f"s{i % 5}") for i in range(300)] + [(300 + i, prose(77, 12), None) for i in range(150)]
    rows += [(500, None), (501, ""), (502, prose(5, 900)), (0, prose(0, 5), "s0"), (None, "x")]
    got = hilbert_shards.shard_documents(documents(spark, rows), dimensions()).collect()
    assert len(got) == len(rows)
    key = lambda d: -1 if d is None else d
    want = sorted((key(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((key(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    total, largest = sum(w[1] for w in want), max(w[1] for w in want)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(by) == list(range(16))
    assert all(abs(sum(r["size"] for r in x) - total / 16) <= largest for x in by.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    # small groups of equal texts stay together
    place = {}
    for r in got:
        place.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(place[zlib.crc32(prose(0, 5).encode())]) == 1
    again = hilbert_shards.shard_documents(documents(spark, rows).repartition(5), dimensions()).collect()
    place = lambda x: sorted((key(r.doc_id), r.text_crc32, r.shard) for r in x)
    assert place(got) == place(again)


def test_shards_of_few_and_no_documents(spark):
    got = hilbert_shards.shard_documents(documents(spark, [(1, "a"), (2, "b")]), dimensions()).collect()
    assert len(got) == 2 and all(r.slot == 0 or r.shard == got[0].shard for r in got)
    assert hilbert_shards.shard_documents(empty(spark), dimensions()).count() == 0


def targets(sizes):
    """Share by weight; stop at three times the source; share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, done = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in done]
        left, w = total - sum(done.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3.0 * sizes[s]]
        if not over:
            return done | {s: left * weight[s] / w for s in free}
        done |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [cube_mix.BLOCK, 16])
def test_mix_meets_targets(spark, monkeypatch, block):
    monkeypatch.setattr(cube_mix, "BLOCK", block)
    rows = [(i, prose(i, 1 + (i * 37) % 90), "hot" if i % 2 else f"s{i % 7}") for i in range(400)]
    rows += [(400 + i, prose(i, 3), "tiny") for i in range(4)] + [(410 + i, prose(i, 30), None) for i in range(20)]
    rows += [(440, None, "s0"), (441, " \n", "void"), (7, prose(7, 20), "hot"), (None, "a b c", "s1")]
    got = cube_mix.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {s: 0 for *_, s in rows}
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want, source = targets(size), {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s], rel=1e-12)
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]) or size[s] < 60
    again = cube_mix.mix(documents(spark, rows).repartition(6)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 500, 300), rng.random(300)
    out = cube_mix.flight(size, p, np.random.default_rng(4))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    # probabilities are those asked for
    mean = np.mean([cube_mix.flight(size[:40], p[:40], np.random.default_rng(i)) for i in range(1500)], axis=0)
    assert np.abs(mean - p[:40]).max() < 0.06


def test_mix_of_no_documents(spark):
    assert cube_mix.mix(empty(spark)).count() == 0
    assert [r.taken for r in cube_mix.mix(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]

"""Suppression: small fingerprints are walked without a join, large ones go through islands, with the same marks."""

import random

import pytest
from pyspark.sql import functions as F

from threatlake.operators import dedup
from threatlake.session import cut_lineage


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_walk_and_islands_agree_with_a_fold(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "FOLD_ROWS", most)
    r = random.Random(8)
    rows = [("h", f"k{int(r.random() ** 3 * 9)}", i, 0, r.randrange(4000)) for i in range(500)]
    rows += [("h", k, s + 1000, 1, t) for _, k, s, _, t in rows[::7]]  # ties of an instant
    want, last = {}, {}
    for h, k, s, p, t in sorted(rows, key=lambda x: (x[4], x[2], x[3])):
        want[s, p] = k not in last or t - last[k] >= 60
        if want[s, p]:
            last[k] = t
    df = spark.createDataFrame(rows, "host string, fingerprint string, seq long, pos int, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    marked = dedup.cooldown(cut_lineage(df), ["host", "fingerprint"], ["seq", "pos"], 60)
    assert marked.columns == ["host", "fingerprint", "seq", "pos", "ts", "emitted"]
    assert {(x.seq, x.pos): x.emitted for x in marked.collect()} == want
    joins = marked._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert (joins == 0) == (most == 10**6)


def test_walk_keeps_its_place_between_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        df = cut_lineage(spark.range(100).selectExpr("'h' AS host", "'k' AS fingerprint", "id AS seq", "0 AS pos", "timestamp_seconds(id) AS ts"))
        marked = dedup.cooldown(df, ["host", "fingerprint"], ["seq", "pos"], 10)
        assert sorted(x.seq for x in marked.where("emitted").collect()) == list(range(0, 100, 10))
    finally:
        spark.conf.set(name, before)


def test_streamed_keys_share_the_state_of_their_bucket(spark, tmp_path):
    from tests.test_streams import FINDING, arriving, at, drained, shuffled
    from threatlake.streaming import operators as ST

    ST.use_rocksdb(spark)
    rows = [(i, (i, "h" if i % 2 else "g", at(i), "x", i % 20, "p", None, None, None, None, None, [("A",)])) for i in range(400)]
    want, last = {}, {}
    for i in range(400):
        want[i] = i % 20 not in last or i - last[i % 20] >= 50
        if want[i]:
            last[i % 20] = i
    events = arriving(spark, tmp_path, shuffled(rows, 3, 60), FINDING)
    got = drained(spark, ST.stream_cooldown(events, 50, "210 seconds", buckets=2), str(tmp_path))
    assert {x.seq: x.emitted for x in got} == want and len(got) == 400

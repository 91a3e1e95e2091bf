"""Scores, severities and store merging on known values and against sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from threatlake.functions.findings import compound_score, severity_class
from threatlake.functions.scan import prefix_scan
from threatlake.operators.dedup import compact_events, cooldown


@pytest.mark.parametrize("points, score", [([60, 35], 68), ([60, 60], 75), ([85, 60], 100), ([15, 0], 15), ([], 0)])
def test_compound_score(spark, points, score):
    df = spark.createDataFrame([(points,)], "p array<int>")
    assert df.select(compound_score(F.col("p"))).first()[0] == score


def test_severity_bands(spark):
    want = {0: "info", 14: "info", 15: "low", 34: "low", 35: "medium", 59: "medium", 60: "high", 84: "high", 85: "critical"}
    df = spark.createDataFrame([(s,) for s in want], "s int")
    assert {r[0]: r[1] for r in df.select("s", severity_class("s")).collect()} == want


def _events(n, keys, span, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice(keys), rnd.randrange(span), rnd.choice([0, 20, 75])) for i in range(n)]


def _fold_cooldown(rows, seconds):
    last, emitted = {}, set()
    for seq, key, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or t - last[key] >= seconds:
            last[key] = t
            emitted.add(seq)
    return emitted


@pytest.mark.parametrize("span", [3000, 60_000])
def test_cooldown_equals_sequential_fold(spark, span):
    """Long islands and many short ones."""
    rows = _events(400, ["hot", "hot", "hot", "b", "c"], span, 7)
    df = spark.createDataFrame(rows, "seq long, key string, t long, score int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.seq for r in cooldown(df, ["key"], ["seq"], 30).where("emitted").collect()}
    assert got == _fold_cooldown(rows, 30)


def test_cooldown_boundary(spark):
    df = spark.createDataFrame([(0, "a", 100), (1, "a", 105), (2, "a", 135)], "seq long, key string, t long")
    out = cooldown(df.withColumn("ts", F.timestamp_seconds("t")), ["key"], ["seq"], 30).orderBy("seq").collect()
    assert [r.emitted for r in out] == [True, False, True]


def test_gap_merge_equals_sequential_fold(spark):
    rows = _events(300, ["x", "y"], 40000, 3)
    df = spark.createDataFrame(rows, "seq long, fingerprint string, t long, score int").withColumns(
        {"ts": F.timestamp_seconds("t"), "host": F.lit("h"), "severity": F.col("score").cast("string"), "summary": F.lit("")}
    )
    got = {(r.id, r.repeat_count, r.score) for r in compact_events(df, 300).collect()}
    want, open_rows = [], {}
    for seq, key, t, score in sorted(rows, key=lambda r: (r[2], r[0])):
        cur = open_rows.get(key)
        if cur and t - cur["last"] <= 300:
            cur.update(last=t, n=cur["n"] + 1, score=max(cur["score"], score))
        else:
            open_rows[key] = cur = {"id": seq, "last": t, "n": 1, "score": score}
            want.append(cur)
    assert got == {(w["id"], w["n"], w["score"]) for w in want}


def test_prefix_scan_equals_running_values(spark):
    rows = _events(300, ["a", "b"], 20000, 5)
    df = spark.createDataFrame(rows, "seq long, k string, t long, v int").withColumn("ts", F.timestamp_seconds("t"))
    got = prefix_scan(df, ["k"], ["ts", "seq"], sums={"s": F.col("v")}, lasts={"l": F.when(F.col("v") == 75, F.col("seq"))}).collect()
    total, last = {}, {}
    for r in sorted(got, key=lambda r: (r.t, r.seq)):
        total[r.k] = total.get(r.k, 0) + r.v
        last[r.k] = r.seq if r.v == 75 else last.get(r.k)
        assert (r.s, r.l) == (total[r.k], last[r.k])

"""Streams against plain Python folds: order across micro-batches, bounded state, retries, and the store that is changed in place."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from threatlake.operators import store, upsert
from threatlake.operators.dedup import compact_events
from threatlake.streaming import operators as ST
from threatlake.streaming.ordered import HEARTBEAT

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENT = "seq long, host string, pid long, ts timestamp, event_type string, remote_ip string, remote_port int, executable string, file_path string, sha256 string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def arriving(spark, tmp_path, batches, schema, ts="ts", beat=10**6):
    """Each list of rows is a micro-batch; a heartbeat follows."""
    place = str(tmp_path / "in")
    kinds = spark.createDataFrame([], schema)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
    names = kinds.columns
    row = tuple(at(beat) if c == ts else HEARTBEAT if c == "event_type" else None for c in names)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(kinds.schema).option("maxFilesPerTrigger", 1).parquet(place)


def finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def drained(spark, df, base):
    finish(df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp"))
    return spark.read.schema(df.schema).parquet(f"{base}/out").collect()


def shuffled(rows, n, late, seed=1):
    """Rows in ``n`` batches by time, each delayed by up to ``late`` seconds."""
    r = random.Random(seed)
    top = max(x[0] for x in rows) + 1
    out = [[] for _ in range(n)]
    for t, row in rows:
        out[min(n - 1, int((t + r.random() * late) * n / top))].append(row)
    for batch in out:
        r.shuffle(batch)
    return out


def test_trackers_of_one_busy_process(spark, tmp_path):
    r = random.Random(2)
    rows, want, counts, ends = [], {}, {}, set()
    for i in range(1200):
        pid = 7 if r.random() < 0.9 else 8
        kind = "process_terminated" if r.random() < 0.01 else "network_connection_observed"
        ip, port = f"10.0.0.{r.randint(1, 9)}", r.choice([80, 443])
        rows.append((i, (i, "h", pid, at(i), kind, ip, port, None, None, None)))
        if kind == "process_terminated":
            counts = {k: v for k, v in counts.items() if k[0] != pid}
            ends = {e for e in ends if e[0] != pid}
        else:
            counts[pid, ip] = counts.get((pid, ip), 0) + 1
            ends.add((pid, ip, port))
            want[i] = (counts[pid, ip], sum(e[0] == pid for e in ends))
    events = arriving(spark, tmp_path, shuffled(rows, 4, 100), EVENT)
    base = str(tmp_path / "run")
    finish(ST.stream_conn_stats(events, base, 450))
    got = spark.read.parquet(f"{base}/out").collect()
    assert {x.seq: (x.connection_count, x.unique_destinations) for x in got} == want and len(got) == len(want)
    assert spark.read.parquet(f"{base}/out").where("connection_count > 0").select("batch").distinct().count() >= 2
    state = spark.read.parquet(f"{base}/carry/4/endpoints")
    assert state.count() == len(ends) and state.agg(F.sum("weight")).first()[0] == sum(counts.values())


def test_old_endpoints_are_forgotten_and_late_rows_set_aside(spark, tmp_path):
    net = lambda i, t, ip: (i, "h", 1, at(t), "network_connection_observed", ip, 80, None, None, None)
    batches = [[net(1, 0, "a"), net(2, 10, "b")], [net(3, 5000, "b")], [net(4, 20, "late"), net(5, 10000, "a")], [net(6, 15000, "c")]]
    base = str(tmp_path / "run")
    finish(ST.stream_conn_stats(arriving(spark, tmp_path, batches, EVENT), base, 100, keep_seconds=3000))
    got = {x.seq: x.connection_count for x in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 5: 1, 6: 1}
    assert [x.seq for x in spark.read.parquet(f"{base}/late").collect()] == [4]


def test_downloads_and_their_connections(spark, tmp_path):
    def ev(i, kind, pid=None, path=None, sha=None):
        return i, (i, "h", pid, at(i), kind, "1.1.1.1", 1, path if kind == "process_started" else None, path if kind.startswith("file") else None, sha)

    rows = [
        ev(0, "file_download_observed", path="C:\\a.exe", sha="x1"), ev(100, "process_started", 5, "c:\\A.exe"), ev(200, "network_connection_observed", 5),
        ev(300, "file_download_observed", path="C:\\a.exe"), ev(400, "process_started", 6, "c:\\a.exe"), ev(500, "process_terminated", 5),
        ev(600, "network_connection_observed", 5), ev(700, "network_connection_observed", 6), ev(800, "process_started", 9, "c:\\other.exe"),
        ev(900, "network_connection_observed", 9),
    ]
    base = str(tmp_path / "run")
    finish(ST.stream_download_corr(arriving(spark, tmp_path, shuffled(rows, 4, 0), EVENT), base, 50))
    got = sorted((x.seq, x.rule_id[-4:], x.download_seq) for x in spark.read.parquet(f"{base}/out").collect())
    assert got == [(100, "TION", 0), (200, "CONN", 0), (400, "TION", 300), (700, "CONN", 300)]


FINDING = "seq long, host string, ts timestamp, event_type string, pid long, process_name string, domain string, remote_ip string, remote_port int, command string, task_name string, findings array<struct<rule_id:string>>"


@pytest.mark.parametrize("busy", [False, True])
def test_cooldown_in_event_order(spark, tmp_path, busy):
    ST.use_rocksdb(spark)
    r = random.Random(3)
    rows, want, last = [], {}, {}
    for i in range(600):
        name = "p" if busy or r.random() < 0.5 else f"p{i % 5}"
        rules = ["A"] if r.random() < 0.7 else ["A", "B"]
        rows.append((i, (i, "h", at(i // 2), "x", 1, name, None, None, None, None, None, [(k,) for k in rules])))
        for pos, k in enumerate(rules):
            passed = (name, k) not in last or i // 2 - last[name, k] >= 10
            if passed:
                last[name, k] = i // 2
            want[i, pos] = passed
    events = arriving(spark, tmp_path, shuffled(rows, 3, 60), FINDING)
    got = drained(spark, ST.stream_cooldown(events, 10, "170 seconds"), str(tmp_path))
    assert {(x.seq, x.pos): x.emitted for x in got} == want and len(got) == len(want)


STORED = "seq long, host string, ts timestamp, event_type string, process_name string, pid long, executable string, severity string, score int, summary string, details_json string, fingerprint string"


def stored_rows(n, keys, span, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        score = r.choice([0, 15, 35, 60])
        t = r.random() * span
        rows.append((t, (i, "h", at(t), "x", f"n{i % 7}", i % 3, "e", f"s{score}", score, f"sum{i}", "{}", f"f{i % keys}")))
    return rows


def as_set(rows):
    return sorted((x.id, x.fingerprint, x.repeat_count, x.score, x.severity, x.summary, x.process_name, x.first_seen, x.last_seen) for x in rows)


@pytest.mark.parametrize("span", [1800, 90_000])
def test_sessions_close_and_none_is_lost(spark, tmp_path, span):
    """Also where all events lie within less than the delay."""
    ST.use_rocksdb(spark)
    rows = stored_rows(500, 4, span)
    events = arriving(spark, tmp_path, shuffled(rows, 3, span / 10), STORED)
    got = drained(spark, ST.stream_compact(events, 60, f"{span // 2} seconds"), str(tmp_path))
    want = compact_events(spark.createDataFrame([x for _, x in rows], STORED), 60).collect()
    assert as_set(got) == as_set(want)


def test_snapshots_started_terminated_reused(spark, tmp_path):
    ST.use_rocksdb(spark)
    seen = {0: {1: 10, 2: 20, 3: 30}, 1: {1: 10, 2: 25}, 2: {2: 25, 3: 33, 4: 40}, 3: {1: 11}}
    batches = [[("h", pid, at(60 * e), life, "process_observed") for pid, life in s.items()] for e, s in seen.items()]
    batches[1].append(batches[0].pop())  # one row arrives with the next snapshot
    schema = "host string, pid long, snapshot_ts timestamp, create_time long, event_type string"
    events = arriving(spark, tmp_path, batches, schema, "snapshot_ts", beat=60 * 3 + 101)
    got = drained(spark, ST.stream_snapshot_diff(events, 60, "100 seconds"), str(tmp_path))
    want, before = [], {}
    for e, now in seen.items():
        for pid in {*before, *now}:
            if pid in before and now.get(pid) != before[pid]:
                want.append((pid, e * 60, "process_terminated", before[pid]))
            if pid in now and before.get(pid) != now[pid]:
                want.append((pid, e * 60, "process_started", now[pid]))
        before = now
    start = int(T0.timestamp())
    assert sorted((x.pid, x.epoch // 1_000_000 - start, x.event_type, x.life) for x in got) == sorted(want)


def test_upsert_over_versions_and_retries(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = stored_rows(400, 6, 5 * 86400)
    frame = lambda part: spark.createDataFrame([x for _, x in part], STORED).withColumn("findings", F.array())
    outbox = {"sync_status": F.lit("pending"), "retry_count": F.lit(0), "last_sync_attempt": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string")}
    compact = lambda part: compact_events(frame(part), 7200).withColumns(outbox).select(*store.STORE_COLUMNS)
    for version in range(3):
        upsert.upsert(compact(rows[version::3]), path, version, 7200, buckets=3)
    schema = compact(rows).schema
    want = as_set(compact(rows).collect())
    assert as_set(upsert.read_live(spark, path, schema).collect()) == want
    upsert.upsert(compact(rows[2::3]), path, 2, 7200, buckets=3)  # a retry of the last batch
    assert as_set(upsert.read_live(spark, path, schema).collect()) == want
    assert as_set(upsert.read_live(spark, path, schema, 0).collect()) == as_set(compact(rows[0::3]).collect())
    # a batch of one fingerprint and day leaves all other folders as they are
    live = {m.path for m in upsert.manifest(spark, path, 2)}
    one = [(0, (9999, "h", at(4.9 * 86400), "x", "n", 1, "e", "s60", 60, "new", "{}", "f1"))]
    upsert.upsert(compact(one), path, 3, 7200, buckets=3)
    after = {m.path for m in upsert.manifest(spark, path, 3)}
    assert 1 <= len(after - live) <= 2 and len(live & after) >= len(live) - 2
    assert as_set(upsert.read_live(spark, path, schema).collect()) == as_set(compact(rows + one).collect())
    assert upsert.vacuum(spark, path, keep=1) > 0 and upsert.versions(spark, path) == [3]
    assert as_set(upsert.read_live(spark, path, schema).collect()) == as_set(compact(rows + one).collect())


def test_merge_keeps_the_first_and_takes_the_higher_score(spark):
    base = dict.fromkeys(store.STORE_COLUMNS)
    row = lambda i, t, score, text, status: {**base, "id": i, "host": "h", "timestamp": at(t), "fingerprint": "f", "repeat_count": 1, "first_seen": at(t), "last_seen": at(t),
                                             "score": score, "severity": f"s{score}", "summary": text, "sync_status": status, "retry_count": 0}
    schema = ("id long, host string, timestamp timestamp, event_type string, process_name string, pid long, executable string, severity string, score int, summary string, "
              "details_json string, fingerprint string, repeat_count long, first_seen timestamp, last_seen timestamp, sync_status string, retry_count int, last_sync_attempt timestamp, error_message string")
    make = lambda *rows: spark.createDataFrame([tuple(r[c] for c in store.STORE_COLUMNS) for r in rows], schema)
    old = make(row(1, 0, 20, "Initial connection", "synced"), row(2, 5000, 20, "far", "synced"))
    touched, merged = store.merge_into_store(old, make(row(3, 100, 75, "Elevated threat", "pending")), 300)
    assert [x.id for x in touched.collect()] == [1]
    got = merged.collect()
    assert [(x.id, x.repeat_count, x.score, x.severity, x.summary, x.sync_status, x.last_seen.replace(tzinfo=timezone.utc) if x.last_seen.tzinfo is None else x.last_seen) for x in got] == [(1, 2, 75, "s75", "Elevated threat", "synced", at(100))]

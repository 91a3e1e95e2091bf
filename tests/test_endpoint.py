"""Endpoint rules and joins on known examples."""

from pyspark.sql import functions as F

from threatlake.functions.findings import rule_ids
from threatlake.functions.scan import order_bounds, prefix_scan, segment_of
from threatlake.operators.correlate import contain_download_persist, containment_candidates
from threatlake.operators.dns import dns_domain_features
from threatlake.operators.evaluate import evaluate
from threatlake.operators.network import with_ip_class
from threatlake.operators.snapshots import diff_processes
from threatlake.operators import store
from threatlake.operators.store import apply_sync, cap, nth_smallest
from threatlake.sources.feeds import load_feeds


def test_rules(spark):
    rows = [
        (1, "process_started", "svchost.exe", "C:\\Users\\a\\AppData\\svchost.exe", None, None),
        (2, "process_started", "svchost.exe", "C:\\Windows\\System32\\svchost.exe", None, None),
        (3, "process_started", "cmd.exe", "C:\\Windows\\System32\\cmd.exe", "WINWORD.EXE", "certutil -urlcache -f http://x"),
        (4, "surprise", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "seq long, event_type string, process_name string, executable string, parent_name string, command_line string")
    got = {r.seq: r.rules.split(",") for r in evaluate(df, load_feeds(spark)).select("seq", rule_ids("findings").alias("rules")).collect()}
    assert "PROC_MASQUERADING" in got[1] and "PROC_WRITABLE_LOCATION" in got[1]
    assert got[2][0] == "PROC_OBSERVED" and "PROC_MASQUERADING" not in got[2]
    assert {"PROC_SUSPICIOUS_PARENT_OFFICE", "PROC_SUSPICIOUS_LOLBIN", "PROC_SUSPICIOUS_COMMAND_LINE"} <= set(got[3])
    assert got[4] == ["GENERIC_EVENT_OBSERVED"]


def test_addresses(spark):
    want = {"8.8.8.8": True, "93.184.216.34": True, "10.0.0.1": False, "169.254.10.20": False, "224.0.0.1": False, "": False,
            "2001:4860:4860::8888": True, "fe80::1": False, "2001:db8::1": False, "not-ip": False}
    df = with_ip_class(spark.createDataFrame([(i,) for i in want], "remote_ip string"))
    assert {r.remote_ip: r.is_public_ip for r in df.collect()} == want


def test_dns(spark):
    df = dns_domain_features(spark.createDataFrame([("mybot.duckdns.org",), ("update-check.top",), ("q89xkm18902vlza09.com",), ("www.google.com",)], "domain string"))
    got = {r.domain: (r.is_dynamic_dns, r.is_suspicious_tld, r.is_potential_dga) for r in df.collect()}
    assert list(got.values()) == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_pid_reuse_yields_both(spark):
    side = lambda t: spark.createDataFrame([("h", 888, t)], "host string, pid long, create_time double")
    assert {r.event_type for r in diff_processes(side(100.0), side(200.0)).collect()} == {"process_started", "process_terminated"}


def test_containment_finds_short_and_long_names(spark):
    names = ["a", "ab.x", "setup.exe", "very-long-installer-name.exe"]
    rows = [(i, "file_download_observed", f"c:\\d\\{n}", n, None) for i, n in enumerate(names)]
    rows += [(10 + i, "startup_item_added", None, None, f"zz{n}zz") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "seq long, event_type string, file_path string, filename string, command string").withColumns(
        {"host": F.lit("h"), "ts": F.timestamp_seconds("seq")})
    got = {r.seq: r.download_seq for r in contain_download_persist(df).collect()}
    for i, n in enumerate(names):
        assert got[10 + i] == min(j for j, m in enumerate(names) if m in f"zz{n}zz")


def test_nth_smallest_and_cap(spark):
    ids = [i * 7 + i % 5 for i in range(500)]
    df = spark.createDataFrame([(i, "high" if k % 4 == 0 else "low") for k, i in enumerate(ids)], "id long, severity string")
    assert [nth_smallest(df, "id", n, bins=4) for n in (1, 250, 500)] == [sorted(ids)[k] for k in (0, 249, 499)]
    kept, gone = cap(df, 100)
    assert gone == 400 and kept.count() == 100 and kept.where("severity <> 'high'").count() == 0


def test_outbox_reset(spark):
    store = spark.createDataFrame([(1, "pending", 0, None, None), (2, "failed", 4, None, "old")], "id long, sync_status string, retry_count int, last_sync_attempt timestamp, error_message string")
    log = spark.createDataFrame([(1, 1, "failed", "x"), (1, 2, "reset", None), (1, 3, "failed", "y"), (2, 1, "synced", None), (2, 2, "reset", None)], "id long, attempt_seq int, outcome string, error string").withColumn("at", F.timestamp_seconds("attempt_seq"))
    got = {r.id: (r.sync_status, r.retry_count, r.error_message) for r in apply_sync(store, log).collect()}
    assert got == {1: ("failed", 1, "y"), 2: ("synced", 4, None)}


def test_store_reads_only_dates_in_reach(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 20:02d} 10:00:00", "low" if i % 3 else "high") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, timestamp string, severity string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    df.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(str(tmp_path / "s"))
    stored = store.read_store(spark, str(tmp_path / "s"))
    recent = store.expire(stored, "2024-01-21", days=5, keep_high=False)
    between = store.query(stored, start_time="2024-01-03", end_time="2024-01-04 12:00:00", limit=1000)
    for out in (recent, between):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan, plan
    assert {r.id % 20 for r in recent.collect()} == {15, 16, 17, 18, 19}
    assert {r.id % 20 for r in between.collect()} == {2, 3}
    assert {r.id for r in store.expire(stored, "2024-01-21", days=5).collect()} == {i for i in range(60) if i % 20 >= 15 or i % 3 == 0}


def test_many_names_with_one_prefix_have_few_candidates(spark):
    names = [f"c:\\downloads\\quarterly-report-{i:05d}.exe" for i in range(10_000)]
    needles = spark.createDataFrame([("h", n) for n in names], "host string, needle string")
    texts = [f'"{names[i]}" /background' for i in range(0, 10_000, 25)] + ["c:\\windows\\explorer.exe"] * 1
    commands = spark.createDataFrame([("h", t) for t in texts], "host string, text string")
    found = containment_candidates(needles, commands)
    right = found.where(F.col("text").contains(F.col("needle"))).count()
    assert right == 400 and found.count() < 40 * 400  # of four million pairs


def test_segments_hold_a_share_of_a_crowded_instant(spark):
    """One host, one hour, and half of the rows in one instant."""
    rows = spark.range(4000).select(
        F.col("id").alias("seq"), F.lit("h").alias("host"), F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("pid"),
        F.timestamp_micros(F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id") * 500_000)).alias("ts"))
    bounds = order_bounds(rows, ["ts", "seq"])
    assert len(bounds) >= 2
    sizes = [r["count"] for r in rows.groupBy(segment_of(["ts", "seq"], bounds).alias("s")).count().collect()]
    assert max(sizes) < 2000 and sum(sizes) == 4000
    assert bounds == order_bounds(rows.orderBy(F.desc("seq")), ["ts", "seq"])
    mark = F.when(F.col("seq") % 7 == 0, F.col("seq"))
    got = prefix_scan(rows, ["host", "pid"], ["ts", "seq"], sums={"n": F.lit(1)}, lasts={"m": mark}, inclusive=False).collect()
    count, last = {}, {}
    for r in sorted(got, key=lambda r: r.seq):
        assert (r.n, r.m) == (count.get(r.pid, 0), last.get(r.pid))
        count[r.pid] = count.get(r.pid, 0) + 1
        if r.seq % 7 == 0:
            last[r.pid] = r.seq

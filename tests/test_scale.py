"""What keeps the event queries in proportion to their input: small lookups by broadcast, unread columns left out, rows read a fixed number of times."""

from pyspark.sql import functions as F

from threatlake.operators.dedup import compact_events
from threatlake.operators.network import with_connection_stats
from threatlake.operators.reputation import with_feed_flags
from threatlake.schemas import conform_events
from threatlake.session import put_down
from threatlake.sources.feeds import load_feeds


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_default_feeds_are_broadcast(spark):
    events = conform_events(spark.range(10).select(F.col("id").alias("seq"), F.lit("usb_inserted").alias("event_type")))
    plan = physical(with_feed_flags(events, load_feeds(spark)))
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def test_merged_rows_leave_out_what_is_not_read(spark):
    rows = spark.range(10).selectExpr(
        "id AS seq", "'h' AS host", "timestamp_micros(id) AS ts", "'x' AS event_type", "'p' AS process_name", "id AS pid", "'e' AS executable",
        "'s' AS severity", "1 AS score", "'m' AS summary", "reverse(cast(id AS string)) AS details_json", "'f' AS fingerprint")
    merged = compact_events(rows, 60)
    assert "reverse(" in merged._jdf.queryExecution().optimizedPlan().toString()
    assert "reverse(" not in merged.drop("details_json")._jdf.queryExecution().optimizedPlan().toString()
    assert merged.first().repeat_count == 10


def test_trackers_read_their_rows_a_fixed_number_of_times(spark):
    rows = conform_events(spark.range(200).selectExpr(
        "id AS seq", "timestamp_micros(id * 1000) AS ts", "'h' AS host", "id % 2 AS pid", "if(id % 50 = 49, 'process_terminated', 'network_connection_observed') AS event_type",
        "concat('1.1.1.', id % 3) AS remote_ip", "CAST(id % 4 AS INT) AS remote_port"))
    stats = with_connection_stats(rows)
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("Scan ExistingRDD") + stats._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    last = {r.seq: (r.connection_count, r.unique_destinations) for r in stats.collect()}
    lives, seen, want = {}, {}, {}
    for i in range(200):
        pid = i % 2
        if i % 50 == 49:
            lives[pid] = lives.get(pid, 0) + 1
            continue
        life = (pid, lives.get(pid, 0))
        hits, pairs = seen.setdefault(life, ({}, set()))
        hits[i % 3] = hits.get(i % 3, 0) + 1
        pairs.add((i % 3, i % 4))
        want[i] = (hits[i % 3], len(pairs))
    assert last == want


def test_wide_rows_are_put_down_by_column(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    kept = put_down(spark.range(100).selectExpr("id", "repeat('x', 1000) AS wide"))
    assert spark.conf.get(name, None) == before
    assert kept.count() == 100 and "ReadSchema: struct<id:bigint>" in physical(kept.select("id"))

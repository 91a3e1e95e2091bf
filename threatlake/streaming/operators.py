"""Streaming forms of the ordered rules and of the store.

Trackers, as-of lookups and approvals run as ordered steps with their state in tables (``ordered``); suppression, sessions and snapshot differences
keep state per key (``keyed``); the sink changes the store in place (``operators.upsert``).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.functions.scan import order_bounds
from threatlake.operators import correlate, network
from threatlake.operators.decisions import consume_allow_once, page_key
from threatlake.operators.evaluate import evaluate
from threatlake.operators.store import to_store
from threatlake.operators.upsert import upsert
from threatlake.schemas import DOWNLOAD_TYPE, NETWORK_TYPE, conform_events
from threatlake.session import cut_lineage
from threatlake.sources.feeds import Feeds
from threatlake.streaming.keyed import stream_compact, stream_cooldown, stream_snapshot_diff, use_rocksdb
from threatlake.streaming.ordered import run_ordered

__all__ = [
    "run_ordered", "stream_allow_once", "stream_compact", "stream_conn_stats", "stream_cooldown", "stream_download_corr", "stream_findings", "stream_sink",
    "stream_snapshot_diff", "use_rocksdb",
]

State = dict[str, DataFrame]
ENDED = "process_terminated"


def _recent(df: DataFrame, rows: DataFrame, keep_seconds: int | None) -> DataFrame:
    """State that was touched in the last ``keep_seconds`` before the newest of ``rows``."""
    if keep_seconds is None:
        return df
    newest = rows.agg(F.max("ts")).first()[0]
    return df if newest is None else df.where(F.col("ts") >= F.lit(newest) - F.expr(f"INTERVAL {keep_seconds} SECONDS"))


# --- trackers ---------------------------------------------------------------------------------------------------------


def conn_step(rows: DataFrame, state: State, keep_seconds: int | None = None) -> tuple[DataFrame, State]:
    """Tracker columns of the network rows. State: the endpoints of each live process with their counts."""
    columns = ["host", "pid", "seq", "ts", "event_type", "remote_ip", "remote_port"]
    both = rows.where(F.col("event_type").isin(NETWORK_TYPE, ENDED)).select(*columns, F.lit(1).cast("bigint").alias("weight"))
    if state:
        known = state["endpoints"].select(
            "host", "pid", F.lit(-1).cast("bigint").alias("seq"), "ts", F.lit(NETWORK_TYPE).alias("event_type"), "remote_ip", "remote_port", "weight"
        )
        both = both.unionByName(known)
    bounds = order_bounds(both, ["ts", "seq"])
    net = cut_lineage(network.with_generation(both, bounds).where(F.col("event_type") == NETWORK_TYPE))
    out = network.with_trackers(net, bounds, F.col("weight")).where(F.col("seq") >= 0)
    ended = both.where(F.col("event_type") == ENDED).groupBy(F.col("host").alias("_h"), F.col("pid").alias("_p")).agg(F.count(F.lit(1)).alias("_lives"))
    live = net.join(ended, F.col("host").eqNullSafe(F.col("_h")) & F.col("pid").eqNullSafe(F.col("_p")), "left")
    live = live.where(F.col("generation") == F.coalesce("_lives", F.lit(0)))
    live = live.groupBy("host", "pid", "remote_ip", "remote_port").agg(F.sum("weight").alias("weight"), F.max("ts").alias("ts"))
    names = ["host", "pid", "seq", "connection_count", "unique_destinations", "is_repeated_burst", "is_wide_fanout"]
    return out.select(*names), {"endpoints": _recent(live, rows, keep_seconds)}


def stream_conn_stats(events: DataFrame, base: str, delay_seconds: int, keep_seconds: int | None = None):
    """Running connection counts and distinct endpoints of each process life. Endpoints not seen for ``keep_seconds`` are forgotten, if given."""
    return run_ordered(conform_events(events), base, partial(conn_step, keep_seconds=keep_seconds), delay_seconds)


def findings_step(rows: DataFrame, state: State, feeds: Feeds, monitors, keep_seconds: int | None = None) -> tuple[DataFrame, State]:
    stats, state = conn_step(rows, state, keep_seconds)
    stats = stats.select(F.col("seq").alias("_seq"), "connection_count", "is_repeated_burst", "is_wide_fanout")
    watched = rows.drop("connection_count", "is_repeated_burst", "is_wide_fanout").join(stats, F.col("seq") == F.col("_seq"), "left").drop("_seq")
    return evaluate(monitors(watched), feeds), state


def stream_findings(events: DataFrame, feeds: Feeds, base: str, delay_seconds: int, monitors=lambda df: df, keep_seconds: int | None = None):
    """Evaluated events with the tracker columns; ``monitors`` adds the columns that depend on a row alone."""
    step = partial(findings_step, feeds=feeds, monitors=monitors, keep_seconds=keep_seconds)
    return run_ordered(conform_events(events), base, step, delay_seconds)


# --- downloads --------------------------------------------------------------------------------------------------------


def download_step(rows: DataFrame, state: State, keep_seconds: int | None = None) -> tuple[DataFrame, State]:
    """Executions of downloads and their connections. State: the last download of each path and of each hash, and the live processes started
    from one."""
    kinds = [DOWNLOAD_TYPE, "process_started", ENDED, NETWORK_TYPE]
    both = correlate.narrow_events(rows, kinds)
    if state:
        both = both.unionByName(state["downloads"])
    started = correlate.asof_downloads(both).where(F.col("download").isNotNull())
    starts = started.where(F.coalesce(F.col("pid"), F.lit(0)) != 0)
    if state:
        starts = starts.unionByName(state["alive"])
    hits = started.select("seq", F.lit("CORR_DOWNLOAD_PROCESS_EXECUTION").alias("rule_id"), F.col("download.seq").alias("download_seq"))
    calls = correlate.asof_process_network(both, starts=starts)
    calls = calls.select("seq", F.lit("CORR_DOWNLOAD_OUTBOUND_CONN").alias("rule_id"), F.col("download.seq").alias("download_seq"))

    place, kept = F.struct("ts", "seq"), F.struct(*[F.col(c) for c in both.columns])
    downloads = both.where(F.col("event_type") == DOWNLOAD_TYPE).withColumns(correlate.download_keys())
    latest = [
        downloads.where(F.col(k).isNotNull()).groupBy("host", k).agg(F.max_by(kept, place).alias("d")).select("d.*") for k in ("_path", "_hash")
    ]
    last = _recent(latest[0].unionByName(latest[1]).dropDuplicates(["host", "seq"]), rows, keep_seconds)
    ends = both.where(F.col("event_type") == ENDED).withColumn("download", F.lit(None).cast(starts.schema["download"].dataType))
    lives = starts.unionByName(ends).groupBy("host", "pid").agg(F.max_by(F.struct(*starts.columns), place).alias("p")).select("p.*")
    alive = _recent(lives.where(F.col("event_type") == "process_started"), rows, keep_seconds)
    return hits.unionByName(calls), {"downloads": last, "alive": alive}


def stream_download_corr(events: DataFrame, base: str, delay_seconds: int, keep_seconds: int | None = None):
    """``seq, rule_id, download_seq``: started downloads, and connections of processes started from one."""
    return run_ordered(conform_events(events), base, partial(download_step, keep_seconds=keep_seconds), delay_seconds)


# --- approvals --------------------------------------------------------------------------------------------------------


def allow_step(rows: DataFrame, state: State, keep_seconds: int | None = None) -> tuple[DataFrame, State]:
    """Visits with ``allowed``. State: the approvals that no visit has used yet."""
    columns = ["user_id", "url", "ts", "seq", "kind"]
    both = rows.select(*columns)
    if state:
        both = both.unionByName(state["approved"])
    last = both.where(F.col("url").rlike("(?i)^https?://")).groupBy("user_id", page_key(F.col("url")).alias("_page")).agg(
        F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("v")
    )
    approved = _recent(last.select("v.*").where(F.col("kind") == "approve"), rows, keep_seconds)
    return consume_allow_once(both).select("seq", "allowed"), {"approved": approved}


def stream_allow_once(events: DataFrame, base: str, delay_seconds: int, keep_seconds: int | None = None):
    """Visits (``user_id, url, ts, seq, kind, event_type``) with whether an approval was open."""
    return run_ordered(events, base, partial(allow_step, keep_seconds=keep_seconds), delay_seconds)


# --- store ------------------------------------------------------------------------------------------------------------


def stream_sink(events: DataFrame, feeds: Feeds, path: str, checkpoint: str, gap: int = V.STORE_GAP_SECONDS, buckets: int = 16):
    """Evaluate and compact each micro-batch and merge it into the store at ``path``; the micro-batch's number is the version, so a retry replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark, place = batch.sparkSession, f"{path}/arrived/{number}"
        to_store(evaluate(batch, feeds), gap).write.mode("overwrite").parquet(place)
        upsert(spark.read.parquet(place), path, number, gap, buckets)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

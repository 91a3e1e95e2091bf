"""The event store: a date-partitioned Parquet table, its history queries, outbox and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.functions.findings import rules_column
from threatlake.functions.text import first_truthy
from threatlake.operators.dedup import compact_events, event_fingerprint

STORE_COLUMNS = [
    "id", "host", "timestamp", "event_type", "process_name", "pid", "executable", "severity", "score", "summary",
    "details_json", "fingerprint", "repeat_count", "first_seen", "last_seen", "sync_status", "retry_count",
    "last_sync_attempt", "error_message",
]
_NOT_DETAILS = {"ts", "event_type", "assessment", "summary", "severity", "score", "target", "has_threats"}


def stored_form(assessed: DataFrame) -> DataFrame:
    """Columns the store keeps of an assessed event, with its fingerprint and JSON details."""
    details = [c for c in assessed.columns if c not in _NOT_DETAILS and not c.startswith("_")]
    return assessed.select(
        "seq", "host", "ts", "event_type",
        first_truthy("process_name", "name", "task_name", "service_name").alias("process_name"),
        "pid",
        first_truthy("executable", "binpath", "command", "task_to_run").alias("executable"),
        "severity", "score", "summary",
        F.to_json(F.struct(*details)).alias("details_json"),
        event_fingerprint(F.transform(rules_column(assessed), lambda f: f["rule_id"])).alias("fingerprint"),
    )


def to_store(assessed: DataFrame, gap: int = V.STORE_GAP_SECONDS) -> DataFrame:
    """Assessed events as merged store rows with a fresh outbox state."""
    merged = compact_events(stored_form(assessed), gap)
    return merged.withColumns(
        {
            "sync_status": F.lit("pending"),
            "retry_count": F.lit(0),
            "last_sync_attempt": F.lit(None).cast("timestamp"),
            "error_message": F.lit(None).cast("string"),
        }
    ).select(*STORE_COLUMNS)


def write_events(store: DataFrame, path: str, mode: str = "append") -> None:
    """Partition by event date; rows sorted by severity inside files so statistics prune."""
    dated = store.withColumn("event_date", F.to_date("timestamp"))
    dated.sortWithinPartitions("event_date", F.desc("score")).write.mode(mode).partitionBy("event_date").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Older files may lack newer columns; they read as null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def merge_into_store(old: DataFrame, batch: DataFrame, gap: int = V.STORE_GAP_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(rows of ``old`` that may change, the rows that replace them) when the compacted rows of ``batch`` are added.

    An old row is touched if its sightings lie within ``gap`` of those of its fingerprint in the batch. The later row of a merge adds
    its repeats and last sighting, and its score, severity and summary where the score is higher; the outbox state stays that of the first."""
    width = F.expr(f"INTERVAL {gap} SECONDS")
    span = batch.groupBy("host", "fingerprint").agg((F.min("first_seen") - width).alias("_lo"), (F.max("last_seen") + width).alias("_hi"))
    near = old.join(span, ["host", "fingerprint"]).where((F.col("last_seen") >= F.col("_lo")) & (F.col("first_seen") <= F.col("_hi")))
    touched = near.select(*STORE_COLUMNS)
    return touched, merge_sessions(touched.unionByName(batch.select(*STORE_COLUMNS)), gap)


def merge_sessions(rows: DataFrame, gap: int = V.STORE_GAP_SECONDS) -> DataFrame:
    """Merge already compacted rows: intervals of one fingerprint closer than ``gap`` become one."""
    from pyspark.sql import Window

    order = Window.partitionBy("host", "fingerprint").orderBy("first_seen", "id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    far = F.unix_micros("first_seen") - F.max(F.unix_micros("last_seen")).over(past) > gap * 1_000_000
    sessions = rows.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int")).withColumn(
        "_s", F.sum("_new").over(order)
    )
    first = F.struct("first_seen", "id")
    head = [c for c in STORE_COLUMNS if c not in (
        "host", "fingerprint", "severity", "score", "summary", "repeat_count", "first_seen", "last_seen")]
    rank = F.struct(F.col("score"), -F.unix_micros("first_seen"), -F.col("id"))
    merged = sessions.groupBy("host", "fingerprint", "_s").agg(
        F.min_by(F.struct(*head), first).alias("_h"),
        F.max_by(F.struct("severity", "score", "summary"), rank).alias("_b"),
        F.sum("repeat_count").alias("repeat_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return merged.select("host", "fingerprint", "_h.*", "_b.*", "repeat_count", "first_seen", "last_seen").select(
        *STORE_COLUMNS
    )


def _since(store: DataFrame, start: Column) -> list[Column]:
    """Tests for rows from ``start`` on; a store from files is partitioned by date, which the second one selects."""
    dated = [F.col("event_date") >= F.to_date(start)] if "event_date" in store.columns else []
    return [F.col("timestamp") >= start, *dated]


def _until(store: DataFrame, end: Column) -> list[Column]:
    dated = [F.col("event_date") <= F.to_date(end)] if "event_date" in store.columns else []
    return [F.col("timestamp") <= end, *dated]


# --- history ---------------------------------------------------------------------------------------


def recent(store: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest rows by id."""
    return store.orderBy(F.desc("id")).limit(int(n))


def query(
    store: DataFrame, *, severity: str | None = None, min_score: int | None = None, max_score: int | None = None,
    event_type: str | None = None, sync_status: str | None = None, start_time=None, end_time=None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """Filtered history, newest first. Times also select date partitions of a store read from files."""
    c = F.col
    tests: list[Column] = []
    if severity:
        tests.append(c("severity") == severity.lower())
    if min_score is not None:
        tests.append(c("score") >= int(min_score))
    if max_score is not None:
        tests.append(c("score") <= int(max_score))
    if event_type:
        tests.append(c("event_type") == event_type)
    if sync_status:
        tests.append(c("sync_status") == sync_status)
    if start_time:
        tests += _since(store, F.lit(start_time).cast("timestamp"))
    if end_time:
        tests += _until(store, F.lit(end_time).cast("timestamp"))
    for test in tests:
        store = store.where(test)
    return store.orderBy(F.desc("id")).offset(max(0, int(offset))).limit(int(limit))


def get(store: DataFrame, event_id: int) -> DataFrame:
    return store.where(F.col("id") == event_id)


def event_stats(store: DataFrame) -> DataFrame:
    """One pass: total, counts by severity and by sync status, top score and time range.

    ``dimension`` is 'total', 'severity' or 'sync_status'; ``value`` names the group.
    """
    sets = store.groupingSets([[F.col("severity")], [F.col("sync_status")], []], "severity", "sync_status").agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.max("score"), F.lit(0)).alias("max_score"),
        F.min("timestamp").alias("oldest"),
        F.max("timestamp").alias("newest"),
        F.grouping("severity").alias("_gs"),
        F.grouping("sync_status").alias("_gy"),
    )
    return sets.select(
        F.when(F.col("_gs") == 0, "severity").when(F.col("_gy") == 0, "sync_status").otherwise("total").alias("dimension"),
        F.coalesce(F.when(F.col("_gs") == 0, F.col("severity")).otherwise(F.col("sync_status")), F.lit("all")).alias("value"),
        "events", "max_score", "oldest", "newest",
    )


# --- outbox ----------------------------------------------------------------------------------------


def pending(store: DataFrame, n: int = V.SYNC_BATCH, max_retries: int = V.SYNC_MAX_RETRIES) -> DataFrame:
    """The ``n`` oldest unsent rows that may still be tried."""
    open_rows = store.where(F.col("sync_status").isin("pending", "failed") & (F.col("retry_count") < max_retries))
    return open_rows.orderBy("id").limit(int(n))


def apply_sync(store: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fold an attempt log (``id, at, attempt_seq, outcome, error``) into the outbox columns.

    Outcomes are 'synced', 'failed' and 'reset'. A reset puts a failed row back to pending with no
    retries, and leaves other rows alone; later attempts count from there.
    """
    place = F.struct("at", "attempt_seq")
    log = attempts.select("id", "at", "attempt_seq", "outcome", "error")
    # A reset acts only if the last real outcome before it is a failure, or a failure it inherits.
    resets = log.where(F.col("outcome") == "reset").select("id", place.alias("_r"))
    real = log.where(F.col("outcome") != "reset").select("id", place.alias("_p"), "outcome", "error", "at")
    before = (
        resets.join(real, "id", "left")
        .groupBy("id", "_r")
        .agg(F.max_by("outcome", F.when(F.col("_p") < F.col("_r"), F.col("_p"))).alias("_last"))
    )
    initial = store.select("id", F.col("sync_status").alias("_s0"))
    valid = (
        before.join(initial, "id")
        .where(F.coalesce(F.col("_last"), F.col("_s0")) == "failed")
        .groupBy("id")
        .agg(F.max("_r").alias("_r"))
    )
    joined = real.join(valid, "id", "left")
    after = F.coalesce(F.col("_p") > F.col("_r"), F.lit(True))
    folded = joined.groupBy("id").agg(
        F.count_if((F.col("outcome") == "failed") & after).alias("_fails"),
        F.max_by(F.struct("outcome", "error"), F.when(after, F.col("_p"))).alias("_end"),
        F.max("at").alias("_at"),
    )
    out = store.join(folded, "id", "left").join(valid, "id", "left")
    was_reset = F.col("_r").isNotNull()
    end = F.col("_end.outcome")
    return out.withColumns(
        {
            "sync_status": F.coalesce(end, F.when(was_reset, F.lit("pending")).otherwise(F.col("sync_status"))),
            "retry_count": (
                F.when(was_reset, F.lit(0)).otherwise(F.col("retry_count")) + F.coalesce(F.col("_fails"), F.lit(0))
            ).cast("int"),
            "error_message": F.when(end == "failed", F.col("_end.error"))
            .when(end.isNotNull() | was_reset, F.lit(None))
            .otherwise(F.col("error_message")),
            "last_sync_attempt": F.coalesce("_at", "last_sync_attempt"),
        }
    ).drop("_fails", "_end", "_at", "_r")


def queue_stats(store: DataFrame, max_retries: int = V.SYNC_MAX_RETRIES) -> DataFrame:
    status = F.col("sync_status")
    return store.agg(
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "synced").alias("synced"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if((status == "failed") & (F.col("retry_count") >= max_retries)).alias("exhausted"),
    )


# --- retention -------------------------------------------------------------------------------------


def _is_high() -> Column:
    return F.col("severity").isin("high", "critical")


def expire(store: DataFrame, as_of, days: int = V.RETENTION_DAYS, keep_high: bool = True) -> DataFrame:
    """Rows that survive the age limit. Without ``keep_high`` only the date partitions in reach are read; severe rows
    are kept from all of them."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(max(1, int(days))))
    fresh = reduce(Column.__and__, _since(store, cutoff))
    return store.where(fresh | _is_high()) if keep_high else store.where(fresh)


def nth_smallest(df: DataFrame, column: str, n: int, bins: int = 1024) -> int | None:
    """Exact n-th smallest value of an integer column by narrowing histograms.

    Each round is one partial aggregation that returns at most ``bins`` counts, so no sort and no
    single-task limit is needed however large ``n`` is.
    """
    lo, hi, total = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= 0 or total == 0:
        return None
    if n >= total:
        return int(hi)
    while lo < hi:
        width = (hi - lo) // bins + 1
        rows = (
            df.where(F.col(column).between(lo, hi))
            .groupBy(F.floor((F.col(column) - lo) / width).cast("bigint").alias("bin"))
            .count()
            .collect()
        )
        for row in sorted(rows):
            if n <= row["count"]:
                lo, hi = lo + row["bin"] * width, min(hi, lo + (row["bin"] + 1) * width - 1)
                break
            n -= row["count"]
    return int(lo)


def cap(store: DataFrame, max_rows: int = V.MAX_STORED_EVENTS, keep_high: bool = True) -> tuple[DataFrame, int]:
    """Keep at most ``max_rows``: oldest rows below high severity go first, then the oldest of all."""
    total, low = store.agg(F.count(F.lit(1)), F.count_if(~_is_high())).first()
    excess = total - max_rows
    if excess <= 0:
        return store, 0
    if not keep_high:
        return store.where(F.col("id") > nth_smallest(store, "id", excess)), excess
    if excess < low:
        cutoff = nth_smallest(store.where(~_is_high()), "id", excess)
        return store.where(_is_high() | (F.col("id") > cutoff)), excess
    kept = store.where(_is_high())
    rest = excess - low
    if rest > 0:
        kept = kept.where(F.col("id") > nth_smallest(kept, "id", rest))
    return kept, excess


def retain(store: DataFrame, as_of, days: int = V.RETENTION_DAYS, max_rows: int = V.MAX_STORED_EVENTS, keep_high: bool = True):
    """Age then capacity; returns the surviving rows and the purge counts."""
    fresh = expire(store, as_of, days, keep_high)
    before = store.count()
    aged = before - fresh.count()
    kept, capped = cap(fresh, max_rows, keep_high)
    return kept, {
        "purged_by_age": aged, "purged_by_capacity": capped, "total_purged": aged + capped,
        "remaining_records": before - aged - capped,
    }

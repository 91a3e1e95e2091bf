"""Alert suppression and store compaction.

Both are defined by a sequential loop per fingerprint. They are computed here without ever putting
a large fingerprint into one task: time is cut into buckets as long as the cooldown or gap, buckets
are pre-aggregated map-side, and only bucket summaries (bounded by time span / bucket length) are
ordered per fingerprint. Suppression walks the sorted rows of fingerprints with at most FOLD_ROWS rows, one at a time and without
holding any, and takes the buckets for larger ones.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from threatlake import fixed_values_endpoint as V
from threatlake.functions.findings import RULES, rules_column, with_assessment
from threatlake.functions.text import blank, first_truthy
from threatlake.session import cut_lineage


#: Rows of the largest fingerprint that one task walks.
FOLD_ROWS = 2_000_000
#: Columns that name an alert beside its event type and rule.
NAMING = ["pid", "process_name", "domain", "remote_ip", "remote_port", "command", "task_name"]


def finding_fingerprint(rule_id: Column) -> Column:
    """Seven fields joined by '|', case kept."""
    parts = [
        blank("event_type"),
        F.when(F.coalesce(F.col("pid"), F.lit(0)) == 0, F.lit("")).otherwise(F.col("pid").cast("string")),
        blank(first_truthy("process_name", "domain")),
        blank(rule_id),
        blank("remote_ip"),
        F.when(F.coalesce(F.col("remote_port"), F.lit(0)) == 0, F.lit("")).otherwise(F.col("remote_port").cast("string")),
        blank(first_truthy("command", "task_name")),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def event_fingerprint(rule_ids: Column) -> Column:
    """Type, lower-cased target, address, port and sorted rule ids."""
    target = F.lower(
        blank(first_truthy("executable", "process_name", "domain", "name", "task_name", "service_name"))
    )
    rules = F.array_join(F.array_sort(F.filter(rule_ids, lambda r: r != "")), ",")
    return F.sha2(
        F.concat_ws(
            "|", F.coalesce(F.col("event_type"), F.lit("unknown")), target, blank("remote_ip"),
            blank(F.col("remote_port").cast("string")), rules,
        ),
        256,
    )


def _bucketed(instants: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Bucket summaries with the island they belong to. A gap of at least ``width`` starts an island."""
    buckets = instants.groupBy(*keys, "_b").agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy(*keys).orderBy("_b")
    starts = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) >= width, F.lit(True))
    return buckets.withColumn("_start", starts.cast("int")).withColumn("_island", F.sum("_start").over(order))


def cooldown_emitted(df: DataFrame, keys: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """``keys, _t``: the instants (microseconds) at which an alert is emitted.

    An alert passes when at least ``seconds`` elapsed since the last alert that passed.
    """
    width = seconds * 1_000_000
    instants = df.select(*keys, F.unix_micros(F.col(ts)).alias("_t")).distinct()
    instants = instants.withColumn("_b", F.floor(F.col("_t") / width).cast("bigint"))
    buckets = _bucketed(instants, keys, width)
    longest = buckets.groupBy(*keys, "_island").agg(F.count(F.lit(1)).alias("_span")).agg(F.max("_span")).first()[0]
    placed = instants.join(buckets.select(*keys, "_b", "_island"), [*keys, "_b"])
    return _jump_emitted(placed, buckets, keys, width, longest or 0)


def _jump_emitted(placed: DataFrame, buckets: DataFrame, keys: list[str], width: int, longest: int) -> DataFrame:
    """Islands by pointer jumping: about log2(buckets of the longest) joins on unique (key, instant) pairs.

    The successor of an instant is the first instant at least ``width`` later. It lies in the next
    bucket, or is the first instant of the first non-empty bucket after that, inside the island: the next one starts anew.
    """
    order = Window.partitionBy(*keys, "_island").orderBy("_b")
    ahead = buckets.select(
        *keys, "_b", "_lo",
        F.lead("_b").over(order).alias("_b1"), F.lead("_lo").over(order).alias("_lo1"),
        F.lead("_lo", 2).over(order).alias("_lo2"), "_start",
    )
    later = F.when(F.col("_b1") == F.col("_b") + 1, F.col("_lo2")).otherwise(F.col("_lo1"))
    data = placed.select(*keys, "_island", "_b", F.col("_t").alias("_at"), F.col("_t").alias("_have"), F.lit(None).cast("bigint").alias("_from"))
    probe = placed.select(
        *keys, "_island", (F.col("_b") + 1).alias("_b"), (F.col("_t") + width).alias("_at"),
        F.lit(None).cast("bigint").alias("_have"), F.col("_t").alias("_from"),
    )
    down = (
        Window.partitionBy(*keys, "_island", "_b")
        .orderBy(F.col("_at").desc(), F.col("_have").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    near = (
        data.unionByName(probe)
        .withColumn("_near", F.last("_have", ignorenulls=True).over(down))
        .where(F.col("_from").isNotNull())
        .select(*keys, F.col("_from").alias("_t"), (F.col("_b") - 1).alias("_b"), "_near")
    )
    jump = (
        near.join(ahead.select(*keys, "_b", later.alias("_later")), [*keys, "_b"])
        .select(*keys, "_t", F.coalesce("_near", "_later").alias("_next"))
        .where(F.col("_next").isNotNull())
    )
    jump = cut_lineage(jump)
    reached = ahead.where(F.col("_start") == 1).select(*keys, F.col("_lo").alias("_t"))
    for _ in range(max(1, math.ceil(math.log2(longest + 1)))):
        hop = reached.join(jump, [*keys, "_t"]).select(*keys, F.col("_next").alias("_t"))
        reached = cut_lineage(reached.unionByName(hop))
        further = jump.select(*keys, F.col("_t").alias("_next"), F.col("_next").alias("_next2"))
        jump = cut_lineage(jump.join(further, [*keys, "_next"]).select(*keys, "_t", F.col("_next2").alias("_next")))
    return reached


def cooldown(df: DataFrame, keys: list[str], place: list[str], seconds: int = V.COOLDOWN_SECONDS, ts: str = "ts") -> DataFrame:
    """Mark each row ``emitted``: first row (by ``place``) of an emitted instant of its key.

    The rows are read several times: pass a table or a frame whose lineage was cut.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FOLD_ROWS).drop("_n")
    large = cut_lineage(large)
    if large.isEmpty():
        return _walked(df, keys, place, seconds, ts)
    rest = _walked(df.join(large, keys, "left_anti"), keys, place, seconds, ts)
    return rest.unionByName(_by_islands(df.join(large, keys, "left_semi"), keys, place, seconds, ts))


def pass_marks(t: list[int], low: int, high: int, last: int | None, width: int, marks: np.ndarray) -> int | None:
    """Mark those of the sorted instants ``t[low:high]`` that pass, a step for each; returns the last one that passed."""
    at = low
    while True:
        if last is not None:
            at = bisect_left(t, last + width, at, high)
        if at >= high:
            return last
        marks[at], last = True, t[at]
        at += 1


def key_starts(columns: list[pa.Array], n: int) -> np.ndarray:
    """Places where a row of sorted columns has another key than the one before."""
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        same = pc.if_else(pc.and_(c[1:].is_null(), c[:-1].is_null()), True, pc.fill_null(pc.equal(c[1:], c[:-1]), False))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _walk(batches: Iterator[pa.RecordBatch], keys: list[str], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by keys and instant, with ``emitted``. All that is kept between batches is the last key and its last emission."""
    before, last = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k) for k in keys]
        instants = batch.column("_t")
        t, nulls = pc.fill_null(instants, -(1 << 62)).to_pylist(), instants.null_count
        starts = key_starts(columns, n).tolist()
        marks = np.zeros(n, bool)
        for low, high in zip(starts, [*starts[1:], n]):
            if low or before != tuple(c[0].as_py() for c in columns):
                last = None
            first = bisect_left(t, -(1 << 61), low, high) if nulls else low
            last = pass_marks(t, first, high, last, width, marks)
        before = tuple(c[-1].as_py() for c in columns)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], [*batch.schema.names, "emitted"])


def _walked(df: DataFrame, keys: list[str], place: list[str], seconds: int, ts: str) -> DataFrame:
    rows = df.withColumn("_t", F.unix_micros(F.col(ts))).repartition(*keys).sortWithinPartitions(*keys, "_t", *place)
    schema = T.StructType([*rows.schema.fields, T.StructField("emitted", T.BooleanType())])
    return rows.mapInArrow(partial(_walk, keys=keys, width=seconds * 1_000_000), schema).drop("_t")


def _by_islands(df: DataFrame, keys: list[str], place: list[str], seconds: int, ts: str) -> DataFrame:
    instant = F.unix_micros(F.col(ts))
    emitted = cooldown_emitted(df, keys, seconds, ts)
    firsts = df.groupBy(*keys, instant.alias("_t")).agg(F.min(F.struct(*place)).alias("_p"))
    chosen = firsts.join(emitted, [*keys, "_t"]).select(
        *keys, *[F.col(f"_p.{c}").alias(c) for c in place], F.lit(True).alias("emitted")
    )
    out = df.join(chosen, [*keys, *place], "left")
    return out.withColumn("emitted", F.coalesce("emitted", F.lit(False)))


def suppress(events: DataFrame, seconds: int = V.COOLDOWN_SECONDS) -> DataFrame:
    """Drop findings inside the cooldown of their fingerprint, and events left with none of theirs.

    Autorun, task and service events are never suppressed.
    """
    bypass = F.coalesce(F.col("event_type").rlike("^(startup_item|scheduled_task|service)_"), F.lit(False))
    long = (
        events.where(~bypass)
        .select("*", F.posexplode(rules_column(events)).alias("_pos", "_f"))
        .select("host", "seq", "ts", "_pos", finding_fingerprint(F.col("_f.rule_id")).alias("fingerprint"))
    )
    marked = cooldown(cut_lineage(long), ["host", "fingerprint"], ["seq", "_pos"], seconds)
    kept = marked.groupBy("host", "seq").agg(
        F.collect_set(F.when(F.col("emitted"), F.col("_pos"))).alias("_kept"),
        F.count_if(~F.col("emitted")).alias("_dropped"),
    )
    joined = events.join(kept, ["host", "seq"], "left")
    live = lambda name: F.filter(F.col(name), lambda f, i: F.array_contains(F.col("_kept"), i))
    names = [name for name in ("findings", RULES) if name in events.columns]
    joined = joined.withColumns(
        {
            **{name: F.when(bypass | F.col("_kept").isNull(), F.col(name)).otherwise(live(name)) for name in names},
            "suppressed_duplicates": F.coalesce(F.col("_dropped"), F.lit(0)),
        }
    ).drop("_kept", "_dropped")
    gone = (F.size("findings") == 0) & (F.col("suppressed_duplicates") > 0)
    return with_assessment(joined.where(~gone), rules_column(joined))


def compact_events(scored: DataFrame, gap: int = V.STORE_GAP_SECONDS, key: str = "fingerprint") -> DataFrame:
    """Merge rows of one fingerprint that follow each other within ``gap`` seconds.

    The merged row keeps the first row's description, counts repeats, spans first to last sighting,
    and takes score, severity and summary of its first highest-scoring row. Each column is aggregated by itself, so that those
    a reader leaves out are neither computed nor shuffled.
    """
    width = gap * 1_000_000
    keys = ["host", key]
    first_fields = [c for c in ("event_type", "process_name", "pid", "executable", "details_json") if c in scored.columns]
    best_fields = ["score", "severity", "summary"]
    place = F.struct("ts", "seq")
    rank = F.struct(F.col("score"), -F.unix_micros("ts"), -F.col("seq"))
    buckets = (
        scored.withColumn("_b", F.floor(F.unix_micros("ts") / width))
        .groupBy(*keys, "_b")
        .agg(
            F.min(F.unix_micros("ts")).alias("_lo"),
            F.max(F.unix_micros("ts")).alias("_hi"),
            F.count(F.lit(1)).alias("_n"),
            F.min(place).alias("_first"),
            *[F.min_by(c, place).alias(f"_first_{c}") for c in first_fields],
            F.max(rank).alias("_rank"),
            *[F.max_by(c, rank).alias(f"_best_{c}") for c in best_fields],
        )
    )
    order = Window.partitionBy(*keys).orderBy("_b")
    new = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > width, F.lit(True)).cast("int")
    sessions = buckets.withColumn("_new", new).withColumn("_s", F.sum("_new").over(order))
    merged = sessions.groupBy(*keys, "_s").agg(
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.sum("_n").alias("repeat_count"),
        *[F.min_by(f"_first_{c}", "_first").alias(c) for c in first_fields],
        F.min("_first").alias("_first"),
        *[F.max_by(f"_best_{c}", "_rank").alias(c) for c in best_fields],
    )
    return merged.select(
        F.col("_first.seq").alias("id"), *keys, F.timestamp_micros("_lo").alias("timestamp"), *first_fields,
        *best_fields, "repeat_count",
        F.timestamp_micros("_lo").alias("first_seen"), F.timestamp_micros("_hi").alias("last_seen"),
    )

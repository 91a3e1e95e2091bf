"""Event-time order over micro-batches, with all state in tables.

Rules that depend on the order of events (trackers, as-of lookups, approvals) are defined on a sorted history. A micro-batch
brings some of it, out of order. ``run_ordered`` holds rows back until the watermark has passed them, and gives each run of released rows to
a step: an ordinary batch computation over the rows and the state tables that the step before it left. The same skew-safe operators work as in
batch, so no key is gathered in a task, and the state is as large as what is open: live endpoints, latest downloads, pending approvals.

All tables carry the number of their micro-batch, and a step reads only those of earlier numbers that the last clock names. A micro-batch that is tried
again overwrites its own tables and nothing else; older state is deleted once its successor is complete. A micro-batch that releases
nothing runs no step and leaves the state where it is.

Rows behind the watermark are set aside in ``late``, as their place in the order is gone. Heartbeat rows (``event_type = 'heartbeat'``) only
move the watermark: a source that falls silent sends them, so that what it sent last is released.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

HEARTBEAT = "heartbeat"
Step = Callable[[DataFrame, dict[str, DataFrame]], tuple[DataFrame, dict[str, DataFrame]]]


def is_heartbeat() -> F.Column:
    return F.coalesce(F.col("event_type") == HEARTBEAT, F.lit(False))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run_ordered(events: DataFrame, base: str, step: Step, delay_seconds: int, ts: str = "ts"):
    """A stream writer that gives the rows of ``events`` to ``step`` in event order and writes what it returns below ``base/out``.

    ``step(rows, state)`` returns its output and the next state; the first state is empty. Its rows are a table."""
    schema, micros = events.schema, F.unix_micros(F.col(ts))

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here, before = f"{base}/state/{number}", f"{base}/state/{number - 1}"
        arrived = _written(batch, f"{here}/arrived")
        state: dict[str, DataFrame] = {}
        top = horizon = kept = older = None
        names: list[str] = []
        if number:
            clock = spark.read.parquet(f"{before}/clock").first()
            top, horizon, kept, older, names = clock.top, clock.horizon, clock.kept, clock.older, clock.names
            state = {name: spark.read.parquet(f"{base}/carry/{kept}/{name}") for name in names}
        newest = arrived.agg(F.max(micros)).first()[0]
        top = max(x for x in (top, newest) if x is not None) if (top, newest) != (None, None) else None
        passed = top - delay_seconds * 1_000_000 if top is not None else None
        if passed is not None and horizon is not None:
            passed = max(passed, horizon)
        rows = arrived.where(~is_heartbeat())
        if horizon is not None:
            rows.where(micros < horizon).write.mode("overwrite").parquet(f"{base}/late/batch={number}")
            rows = rows.where(micros >= horizon)
        if number:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{before}/pending"))
        released = micros < passed if passed is not None else F.lit(False)
        _written(rows.where(~released), f"{here}/pending")
        ready, gone = _written(rows.where(released), f"{here}/ready"), None
        if not ready.isEmpty():
            out, carry = step(ready, state)
            for name, df in carry.items():
                _written(df, f"{base}/carry/{number}/{name}")
            out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
            gone, older, kept, names = older, kept, number, list(carry)  # a retry still reads what was kept before
        clock = spark.createDataFrame([(top, passed, kept, older, names)], "top long, horizon long, kept long, older long, names array<string>")
        clock.coalesce(1).write.mode("overwrite").parquet(f"{here}/clock")
        _delete(spark, f"{base}/state/{number - 2}")
        if gone is not None:
            _delete(spark, f"{base}/carry/{gone}")

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint")

"""Differences of two snapshots: one full outer join on the key, whatever the kind of object."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from threatlake import fixed_values_endpoint as V


def diff_snapshot(
    prev: DataFrame, cur: DataFrame, keys: list[str], compare: list[str], labels: tuple[str, str, str],
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Rows added, changed in any ``compare`` column, or removed, labelled as ``event_type``.

    ``labels`` is (added, modified, removed). ``previous`` maps a column to the name under which its
    old value is reported for modified rows.
    """
    values = [c for c in cur.columns if c not in keys]
    p = prev.select(*keys, F.struct(*values).alias("_p"))
    c = cur.select(*keys, F.struct(*values).alias("_c"))
    both = c.join(p, keys, "full_outer")
    changed = reduce(
        lambda a, b: a | b, [~F.col(f"_c.{n}").eqNullSafe(F.col(f"_p.{n}")) for n in compare], F.lit(False)
    )
    kind = (
        F.when(F.col("_p").isNull(), labels[0])
        .when(F.col("_c").isNull(), labels[2])
        .when(changed, labels[1])
    )
    out = both.withColumn("event_type", kind).where(F.col("event_type").isNotNull())
    old = {
        name: F.when(F.col("event_type") == labels[1], F.col(f"_p.{col}")) for col, name in (previous or {}).items()
    }
    kept = F.coalesce(F.col("_c"), F.col("_p"))
    return out.withColumns({**old, "_k": kept}).select(*keys, "event_type", "_k.*", *old)


def diff_startup(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return diff_snapshot(
        prev, cur, ["host", "item_id"], ["command"],
        ("startup_item_added", "startup_item_modified", "startup_item_removed"), {"command": "previous_command"},
    )


def diff_tasks(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return diff_snapshot(
        prev, cur, ["host", "task_name"], ["task_to_run", "run_as_user"],
        ("scheduled_task_created", "scheduled_task_modified", "scheduled_task_deleted"),
        {"task_to_run": "previous_task_to_run"},
    )


def diff_services(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Services are matched by lower-cased name."""
    keyed = lambda d: d.withColumn("service_key", F.lower("name"))
    return diff_snapshot(
        keyed(prev), keyed(cur), ["host", "service_key"], ["binpath", "start_type", "status"],
        ("service_installed", "service_modified", "service_removed"),
        {"binpath": "previous_binpath", "status": "previous_status", "start_type": "previous_start_type"},
    )


def diff_processes(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Started and terminated processes; a reused pid (other creation time) yields both."""
    keys = ["host", "pid"]
    values = [c for c in cur.columns if c not in keys]
    both = cur.select(*keys, F.struct(*values).alias("_c")).join(
        prev.select(*keys, F.struct(*values).alias("_p")), keys, "full_outer"
    )
    reused = F.coalesce(F.col("_c.create_time") != F.col("_p.create_time"), F.lit(False))
    rows = F.array_compact(
        F.array(
            F.when(
                F.col("_c").isNotNull() & (F.col("_p").isNull() | reused),
                F.struct(F.lit("process_started").alias("event_type"), F.col("_c").alias("v")),
            ),
            F.when(
                F.col("_p").isNotNull() & (F.col("_c").isNull() | reused),
                F.struct(F.lit("process_terminated").alias("event_type"), F.col("_p").alias("v")),
            ),
        )
    )
    return both.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.event_type", "_r.v.*")


def new_keys(prev: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``cur`` whose key is absent from ``prev``; null key parts compare as equal."""
    p = prev.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return cur.join(p, on, "left_anti")


CONNECTION_KEY = ["host", "pid", "protocol", "local_ip", "local_port", "remote_ip", "remote_port"]


def new_connections(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """One row per connection key not seen before (the last observation of the key)."""
    carried = [c for c in cur.columns if c not in CONNECTION_KEY]
    latest = cur.groupBy(*CONNECTION_KEY).agg(F.max_by(F.struct(*carried), F.struct("ts", "seq")).alias("_v"))
    return new_keys(prev, latest.select(*CONNECTION_KEY, "_v.*"), CONNECTION_KEY)


def new_dns(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return new_keys(prev, cur, ["host", "domain"])


def is_temp_download(extension):
    return F.lower(extension).isin(*V.TEMP_DOWNLOAD_EXTENSIONS)


def diff_downloads(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Finished files that are new, or were still temporary before (columns ``host, path, ext``)."""
    old = prev.select("host", "path", is_temp_download(F.col("ext")).alias("_was_temp"))
    joined = cur.where(~is_temp_download(F.col("ext"))).join(old, ["host", "path"], "left")
    return joined.where(F.col("_was_temp").isNull() | F.col("_was_temp")).drop("_was_temp")

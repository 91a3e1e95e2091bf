"""Correlation across events: downloads with later executions, connections and persistence.

The "latest earlier download" lookups are last-known-value scans (``prefix_scan``), so neither a
busy host nor a popular path is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.findings import RULES, as_rules, finding, findings_of, sentence
from threatlake.functions.scan import Bounds, order_bounds, prefix_scan
from threatlake.functions.text import base_name, blank, first_truthy, is_true
from threatlake.schemas import DOWNLOAD_TYPE, NETWORK_TYPE, PERSISTENCE_TYPES, conform_events


def _low(*cols: str) -> Column:
    return F.lower(first_truthy(*cols))


def _download_info() -> Column:
    return F.struct(
        _low("file_path", "executable").alias("path"),
        F.col("filename").alias("filename"),
        F.col("download_url").alias("download_url"),
        F.col("mark_of_the_web").alias("mark_of_the_web"),
        F.col("ts").alias("ts"),
        F.col("seq").alias("seq"),
    )


def narrow_events(events: DataFrame, types: list[str]) -> DataFrame:
    """Only the columns a correlation reads, for the event types it reads."""
    return (
        conform_events(events)
        .where(F.col("event_type").isin(*types))
        .select(
            "seq", "host", "ts", "event_type", "pid", "process_name", "executable", "file_path", "filename",
            "sha256", "file_metadata", "download_url", "mark_of_the_web", "remote_ip", "remote_port",
            "threat_flagged", "is_foreign", "command", "task_to_run", "binpath",
        )
    )


def download_keys() -> dict[str, Column]:
    """Path and hash under which a download is found by a process start."""
    is_dl = F.col("event_type") == DOWNLOAD_TYPE
    own = F.coalesce(first_truthy("sha256"), first_truthy("file_metadata.sha256"))
    return {
        "_path": F.when(is_dl, _low("file_path", "executable")).otherwise(_low("executable")),
        "_hash": F.lower(F.when(is_dl, own).otherwise(first_truthy("file_metadata.sha256"))),
    }


def asof_downloads(events: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Process starts with ``download``: the latest earlier download of the same path, else hash."""
    rows = narrow_events(events, [DOWNLOAD_TYPE, "process_started"])
    is_dl = F.col("event_type") == DOWNLOAD_TYPE
    bounds = order_bounds(rows, ["ts", "seq"]) if bounds is None else bounds
    rows = rows.withColumns({**download_keys(), "_info": F.when(is_dl, _download_info())})
    by_path = prefix_scan(
        rows, ["host", "_path"], ["ts", "seq"], bounds=bounds,
        lasts={"_by_path": F.when(F.col("_path").isNotNull(), F.col("_info"))},
    )
    by_hash = prefix_scan(
        by_path, ["host", "_hash"], ["ts", "seq"], bounds=bounds, source=rows,
        lasts={"_by_hash": F.when(F.col("_hash").isNotNull(), F.col("_info"))},
    )
    return (
        by_hash.where(~is_dl)
        .withColumn("download", F.coalesce("_by_path", "_by_hash"))
        .drop("_path", "_hash", "_info", "_by_path", "_by_hash")
    )


def corr_download_exec(events: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """``host, seq, findings`` for executions of downloaded files."""
    hits = asof_downloads(events, bounds).where(F.col("download").isNotNull())
    d = F.col("download")
    found = finding(
        "CORR_DOWNLOAD_PROCESS_EXECUTION", "Downloaded file was executed", "medium", "high",
        sentence("'{n}' (PID {p}) started from downloaded file '{f}'.", n=F.col("process_name"), p=F.col("pid"), f=d["path"]),
        {"process_name": F.col("process_name"), "pid": F.col("pid"), "download_path": d["path"],
         "download_url": d["download_url"], "mark_of_the_web": d["mark_of_the_web"]},
    )
    return hits.select("host", "seq", findings_of(found).alias("findings"))


def downloaded_starts(events: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Process starts with a pid whose ``download`` is known."""
    return asof_downloads(events, bounds).where(F.col("download").isNotNull() & (F.coalesce(F.col("pid"), F.lit(0)) != 0))


def asof_process_network(events: DataFrame, bounds: Bounds | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Network events with ``download``: origin of the last downloaded execution of the pid, if still alive.

    ``starts`` are the downloaded starts, where they are known already."""
    if bounds is None:
        bounds = order_bounds(events.where(F.col("event_type").isin(DOWNLOAD_TYPE, "process_started", "process_terminated", NETWORK_TYPE)), ["ts", "seq"])
    if starts is None:
        starts = downloaded_starts(events, bounds)
    others = narrow_events(events, [NETWORK_TYPE, "process_terminated"]).withColumn(
        "download", F.lit(None).cast(starts.schema["download"].dataType)
    )
    rows = starts.unionByName(others)
    marker = F.when(
        F.col("event_type") != NETWORK_TYPE,
        F.struct((F.col("event_type") == "process_started").alias("alive"), F.col("download").alias("download")),
    )
    scanned = prefix_scan(
        rows.withColumnRenamed("download", "_own").withColumn("download", F.col("_own")).drop("_own"),
        ["host", "pid"], ["ts", "seq"], lasts={"_state": marker}, bounds=bounds,
    )
    return (
        scanned.where((F.col("event_type") == NETWORK_TYPE) & F.col("_state.alive"))
        .withColumn("download", F.col("_state.download"))
        .drop("_state")
    )


def corr_download_net(events: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    hits = asof_process_network(events, bounds)
    d = F.col("download")
    found = finding(
        "CORR_DOWNLOAD_OUTBOUND_CONN", "Downloaded program opened a connection",
        F.when(is_true("threat_flagged") | is_true("is_foreign"), "high").otherwise("medium"), "high",
        sentence("'{n}' (PID {p}) from downloaded file '{f}' opened {i}:{q}.", n=F.col("process_name"),
                 p=F.col("pid"), f=d["path"], i=F.col("remote_ip"), q=F.col("remote_port")),
        {"process_name": F.col("process_name"), "pid": F.col("pid"), "remote_ip": F.col("remote_ip"),
         "remote_port": F.col("remote_port"), "download_url": d["download_url"]},
    )
    return hits.select("host", "seq", findings_of(found).alias("findings"))


# Substring joins meet in an inverted index of q-grams. A text that contains a needle contains all its grams, so any one of
# them finds every match; the one that the fewest texts of the host hold finds the fewest others. Every candidate is verified.
GRAM = 4


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct pieces of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, size)))


def containment_candidates(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """``host, needle, text`` pairs that share the needle's rarest gram, out of ``needles(host, needle)`` and ``texts(host, text)``, both distinct.

    Needles shorter than GRAM are their own gram. A needle with a gram that no text of its host holds meets none."""
    size = F.least(F.length("needle"), F.lit(GRAM))
    of_needle = needles.select("host", "needle", F.explode(_grams(F.col("needle"), size)).alias("gram"))
    keyed = texts.select("host", "text", F.xxhash64("text").alias("_id"))
    windows = F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])))
    of_text = keyed.select("host", "_id", F.explode(windows).alias("gram"))
    held = of_text.join(of_needle.select("host", "gram").distinct(), ["host", "gram"]).distinct()
    counts = held.groupBy("host", "gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        of_needle.join(counts, ["host", "gram"], "left")
        .groupBy("host", "needle")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_r"))
        .where(F.col("_r.n") > 0)
        .select("host", "needle", F.col("_r.gram").alias("gram"))
    )
    return rarest.join(held, ["host", "gram"]).join(keyed, ["host", "_id"]).select("host", "needle", "text")


def contain_download_persist(events: DataFrame) -> DataFrame:
    """``host, seq, download_seq, download_path`` of persistence commands naming a downloaded file.

    The first registered download (by path) wins, and it must precede the event. Downloads are
    reduced to one row per host and needle, commands to one row per host and text, before they meet.
    """
    rows = narrow_events(events, [DOWNLOAD_TYPE, *PERSISTENCE_TYPES])
    place = F.struct("ts", "seq")
    downloads = rows.where(F.col("event_type") == DOWNLOAD_TYPE).select(
        "host", "ts", "seq", _low("file_path", "executable").alias("path"), F.lower(blank("filename")).alias("name")
    ).where(F.col("path").isNotNull())
    registered = downloads.groupBy("host", "path", "name").agg(F.min(place).alias("first"))
    needles = (
        registered.select("host", "path", "first", F.explode(F.array_distinct(F.array("path", "name"))).alias("needle"))
        .where(F.col("needle") != "")
        .groupBy("host", "needle")
        .agg(F.min("first").alias("first"), F.min_by("path", "first").alias("path"))
    )
    commands = rows.where(F.col("event_type").isin(*PERSISTENCE_TYPES)).select(
        "host", "ts", "seq", F.lower(blank(first_truthy("command", "task_to_run", "binpath"))).alias("text")
    ).where(F.col("text") != "")
    found = containment_candidates(needles.select("host", "needle"), commands.select("host", "text").distinct())
    pairs = (
        found.where(F.col("text").contains(F.col("needle")))
        .join(needles, ["host", "needle"])
        .groupBy("host", "text")
        .agg(F.min("first").alias("first"), F.min_by("path", "first").alias("download_path"))
    )
    return (
        commands.join(pairs, ["host", "text"])
        .where(F.col("first") < place)
        .select("host", "seq", "text", F.col("first.seq").alias("download_seq"), "download_path")
    )


def corr_download_persist(events: DataFrame) -> DataFrame:
    hits = contain_download_persist(events)
    found = finding(
        "CORR_DOWNLOAD_PERSISTENCE", "Downloaded file was made persistent", "high", "high",
        sentence("Downloaded file '{f}' is started by: {c}.", f=F.col("download_path"), c=F.col("text")),
        {"command": F.col("text"), "download_path": F.col("download_path")},
    )
    return hits.select("host", "seq", findings_of(found).alias("findings"))


def correlation_findings(events: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """``host, seq, _extra``: the cross-event findings."""
    bounds = order_bounds(events, ["ts", "seq"]) if bounds is None else bounds
    return (
        corr_download_exec(events, bounds)
        .unionByName(corr_download_net(events, bounds))
        .unionByName(corr_download_persist(events))
        .withColumnRenamed("findings", "_extra")
    )


def with_correlations(events: DataFrame, judge, bounds: Bounds | None = None) -> DataFrame:
    """Events with the findings that ``judge`` gives each, and the cross-event findings after them. Those are joined first, while rows are
    shorter."""
    joined = judge(events.join(correlation_findings(events, bounds), ["host", "seq"], "left"))
    added = {"findings": F.col("_extra")}
    if RULES in joined.columns:
        added[RULES] = as_rules("_extra")
    return joined.withColumns(
        {name: F.when(F.col("_extra").isNotNull(), F.concat(name, extra)).otherwise(F.col(name)) for name, extra in added.items()}
    ).drop("_extra")


def with_owner(net: DataFrame, processes: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Attach the owning process (latest start of the pid) to each socket; ownerless sockets are dropped."""
    fields = ["process_name", "executable", "command_line", "username", "parent_name", "parent_pid"]
    sockets = net.drop(*fields).withColumn("_owner", F.lit(None).cast(
        processes.select(F.struct(*fields).alias("o")).schema["o"].dataType))
    owners = processes.select("host", "pid", "ts", "seq", F.struct(*fields).alias("_owner"))
    rows = sockets.withColumn("_net", F.lit(True)).unionByName(owners, allowMissingColumns=True)
    out = prefix_scan(
        rows, ["host", "pid"], ["ts", "seq"], lasts={"_last": F.col("_owner")}, bounds=bounds
    )
    out = out.where(F.col("_net")).select("*", "_last.*").drop("_owner", "_last", "_net")
    unknown = F.coalesce(F.col("process_name"), F.lit("unknown")) == "unknown"
    return out.where(~(unknown & (blank("executable") == "")))


def with_parent(processes: DataFrame) -> DataFrame:
    """Parent name by pid inside one snapshot (columns ``host, snapshot_ts`` identify it)."""
    parents = processes.select(
        F.col("host"), F.col("snapshot_ts"), F.col("pid").alias("parent_pid"), F.col("process_name").alias("parent_name")
    )
    return processes.drop("parent_name").join(parents, ["host", "snapshot_ts", "parent_pid"], "left")

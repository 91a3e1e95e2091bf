"""Address class, hosting provider, suspicious client, and connection trackers."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.functions.patterns import from_python
from threatlake.functions.scan import Bounds, order_bounds, prefix_scan
from threatlake.functions.text import blank, first_match, in_list
from threatlake.session import cut_lineage


def _where(only: Column | None, value: Column) -> Column:
    return value if only is None else F.when(only, value)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad without leading zeros as a number, null for anything else."""
    octet = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    ok = ip.rlike(rf"^{octet}(?:\.{octet}){{3}}\z")
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("bigint")
    return F.when(ok, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def _within(number: Column, blocks) -> Column:
    test = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        test = test | number.between(int(net.network_address), int(net.broadcast_address))
    return test


def with_ip_class(df: DataFrame, ip: str = "remote_ip", out: str = "is_public_ip", only: Column | None = None) -> DataFrame:
    """Flag globally routable unicast addresses; ``only`` names the rows to look at.

    IPv4 by number ranges; IPv6 as global unicast outside its special-purpose blocks. The parsed
    forms are columns of their own, so that each is computed once per row.
    """
    text = _where(only, F.lower(F.trim(F.col(ip))))
    mapped = F.nullif(F.regexp_extract(text, r"^::ffff:(\d+\.\d+\.\d+\.\d+)\z", 1), F.lit(""))
    hextets = r"^([0-9a-f]{1,4}):(?:([0-9a-f]{1,4}):)?[0-9a-f:.]*\z"
    df = df.withColumns({"__ip": F.coalesce(mapped, text)})
    df = df.withColumns(
        {
            "__v4": ipv4_number(F.col("__ip")),
            "__h1": F.conv(F.nullif(F.regexp_extract("__ip", hextets, 1), F.lit("")), 16, 10).try_cast("int"),
            "__h2": F.conv(F.nullif(F.regexp_extract("__ip", hextets, 2), F.lit("")), 16, 10).try_cast("int"),
        }
    )
    v4, first, second = F.col("__v4"), F.col("__h1"), F.coalesce(F.col("__h2"), F.lit(0))
    public_v4 = ~_within(v4, V.IPV4_NON_GLOBAL) | _within(v4, V.IPV4_GLOBAL_EXCEPTIONS)
    special_2001 = (first == 0x2001) & (
        (second == 0xDB8)
        | ((second < 0x200) & (second != 0x3) & ~second.between(0x20, 0x3F) & ~F.col("__ip").startswith("2001:4:112:"))
    )
    well_formed = ~F.col("__ip").rlike(r":::|::.*::")
    public_v6 = well_formed & first.between(0x2000, 0x3FFF) & ~special_2001 & (first != 0x2002)
    public = F.when(v4.isNotNull(), public_v4).otherwise(public_v6)
    return df.withColumn(out, F.coalesce(public, F.lit(False))).drop("__ip", "__v4", "__h1", "__h2")


def hosting_provider(org: Column, asn: Column) -> Column:
    text = F.trim(F.concat(blank(org), F.lit(" "), blank(asn)))
    return first_match(text, V.HOSTING_PATTERNS, from_python)


def with_hosting(df: DataFrame, api_flag: str | None = None, only: Column | None = None) -> DataFrame:
    """Provider named by organisation or ASN; a bare provider flag from the feed still counts. ``only`` names the rows to look up."""
    named = _where(only, hosting_provider(F.col("org"), F.col("asn")))
    flagged = F.coalesce(F.col(api_flag), F.lit(False)) if api_flag else F.lit(False)
    return df.withColumns(
        {
            "hosting_provider": F.coalesce(named, F.when(flagged, F.lit("Cloud / Hosting Provider"))),
            "is_hosting": flagged | named.isNotNull(),
        }
    )


def is_suspicious_client(process_name: Column) -> Column:
    return in_list(F.lower(process_name), V.SUSPICIOUS_CLIENTS)


def with_generation(df: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Number the lives of a pid: the count of earlier terminations of ``(host, pid)``."""
    return prefix_scan(
        df,
        ["host", "pid"],
        ["ts", "seq"],
        sums={"generation": F.when(F.col("event_type") == "process_terminated", 1).otherwise(0)},
        inclusive=False,
        bounds=bounds,
    )


def process_identity(pid: Column, create_time: Column) -> Column:
    return F.concat_ws("_", pid.cast("string"), F.coalesce(create_time, F.lit(0)).cast("bigint").cast("string"))


def with_burst(
    net: DataFrame, threshold: int = V.BURST_THRESHOLD, bounds: Bounds | None = None, weight: Column | None = None
) -> DataFrame:
    """Running observations per process life and destination; every observation counts, or its ``weight``."""
    out = prefix_scan(
        net,
        ["host", "pid", "generation", "remote_ip"],
        ["ts", "seq"],
        sums={"connection_count": F.lit(1) if weight is None else weight},
        bounds=bounds,
    )
    return out.withColumn("is_repeated_burst", F.col("connection_count") >= threshold)


_LIFE = ["host", "pid", "generation"]


def _with_first_sighting(net: DataFrame) -> DataFrame:
    """Add ``__first``: whether the row is the first of its (address, port) pair in its process life.

    The first sighting of each pair comes from a map-side combined minimum rather than a window
    over the pair, so a single busy destination cannot overload one task.
    """
    pair = [*_LIFE, "remote_ip", "remote_port"]
    firsts = net.groupBy(*pair).agg(F.min(F.struct("ts", "seq")).alias("__at")).select(
        *[F.col(c).alias(f"__f_{c}") for c in pair], F.col("__at.seq").alias("__f_seq")
    )
    on = F.col("seq") == F.col("__f_seq")
    for c in pair:
        on = on & F.col(c).eqNullSafe(F.col(f"__f_{c}"))
    marked = net.join(firsts, on, "left").withColumn("__first", F.col("__f_seq").isNotNull())
    return marked.drop("__f_seq", *[f"__f_{c}" for c in pair])


def with_trackers(
    net: DataFrame, bounds: Bounds | None = None, weight: Column | None = None,
    burst: int = V.BURST_THRESHOLD, fanout: int = V.FANOUT_THRESHOLD,
) -> DataFrame:
    """Running observations per destination, and running distinct (address, port) pairs, per process life. The marked rows are put down, as
    each step reads them more than once: pass narrow ones, cut already."""
    marked = cut_lineage(_with_first_sighting(net))
    out = prefix_scan(
        with_burst(marked, burst, bounds, weight),
        _LIFE,
        ["ts", "seq"],
        sums={"unique_destinations": F.when(F.col("__first"), 1).otherwise(0)},
        bounds=bounds,
        source=marked,
    )
    return out.drop("__first").withColumn("is_wide_fanout", F.col("unique_destinations") >= fanout)


def with_connection_stats(events: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Burst and fanout flags on the network events of a mixed event table, with the columns that identify and place them."""
    kept = events.where(F.col("event_type").isin("network_connection_observed", "process_terminated"))
    kept = kept.select("seq", "host", "ts", "event_type", "pid", "remote_ip", "remote_port")
    bounds = order_bounds(kept, ["ts", "seq"]) if bounds is None else bounds
    net = cut_lineage(with_generation(kept, bounds).where(F.col("event_type") == "network_connection_observed"))
    return with_trackers(net, bounds)


def active_processes(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Latest life of each pid that has not ended by ``as_of``; one aggregation, no window."""
    seen = events if as_of is None else events.where(F.col("ts") <= as_of)
    seen = seen.where(F.col("event_type").isin("process_started", "process_observed", "process_terminated"))
    place = F.struct("ts", "seq")
    latest = seen.groupBy("host", "pid").agg(
        F.max_by(
            F.struct("event_type", "process_name", "executable", "create_time", "ts", "seq"), place
        ).alias("p")
    )
    return latest.where(F.col("p.event_type") != "process_terminated").select(
        "host", "pid", process_identity(F.col("pid"), F.col("p.create_time")).alias("identity"),
        "p.process_name", "p.executable", "p.ts", "p.seq",
    )

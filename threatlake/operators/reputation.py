"""Reputation joins: hash, address, domain and publisher lookups against feed tables.

Feeds are joined by equality without a broadcast hint: the optimizer broadcasts a feed whose
measured size is under ``autoBroadcastJoinThreshold`` and shuffles otherwise, so a feed that grows
to millions of indicators still joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from threatlake.schemas import DOWNLOAD_TYPE
from threatlake.sources.feeds import Feeds, feed_lookup
from threatlake.functions.text import blank, contains_any

MAX_PUBLISHERS = 1_000


def normal_hash(c: Column) -> Column:
    return F.trim(F.lower(c))


def normal_ip(c: Column) -> Column:
    return F.trim(c)


def normal_domain(c: Column) -> Column:
    return F.rtrim(F.lower(F.trim(c)), F.lit("."))


_NORMAL = {"hash": normal_hash, "ip": normal_ip, "domain": normal_domain}


def with_reputation(df: DataFrame, feed: DataFrame, key: Column | str, kind: str, prefix: str | None = None) -> DataFrame:
    """Add ``{prefix}_status`` (malicious / trusted / unknown), flags and the threat name.

    Rows without a key match nothing and stay in the result; where the feed is shuffled they are dealt to all partitions by a hash of the row instead of
    meeting in one.
    """
    prefix = prefix or kind
    key = F.col(key) if isinstance(key, str) else key
    lookup = feed_lookup(feed).select(
        F.col("indicator").alias("__ind"),
        F.col("is_blocklisted").alias("__b"),
        F.col("is_listed_allow").alias("__a"),
        F.col("threat_name").alias(f"{prefix}_threat"),
    )
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    if "seq" in plain:  # tells events apart; a hash of all columns would keep them all alive
        plain = [c for c in ("host", "seq", "ts") if c in plain]
    nowhere = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(1 << 16)).cast("string"))
    keyed = df.withColumn("__key", F.coalesce(F.nullif(_NORMAL[kind](key), F.lit("")), nowhere))
    joined = keyed.join(lookup, F.col("__key") == F.col("__ind"), "left")
    blocked = F.coalesce(F.col("__b"), F.lit(False))
    listed = F.coalesce(F.col("__a"), F.lit(False))
    return joined.withColumns(
        {
            f"{prefix}_blocklisted": blocked,
            f"{prefix}_allowlisted": ~blocked & listed,
            f"{prefix}_on_allowlist": listed,
            f"{prefix}_status": F.when(blocked, "malicious").when(listed, "trusted").otherwise("unknown"),
        }
    ).drop("__key", "__ind", "__b", "__a")


def with_publisher(df: DataFrame, publishers: DataFrame, signer: Column | str, out: str = "trusted_publisher") -> DataFrame:
    """Flag signers that contain a trusted publisher name, ignoring case.

    Containment is tested against literal names in the projection, so no join is needed. The list
    is a hand-kept policy list; a table larger than ``MAX_PUBLISHERS`` is refused rather than
    pulled through the driver.
    """
    signer = F.col(signer) if isinstance(signer, str) else signer
    rows = publishers.select("publisher").distinct().limit(MAX_PUBLISHERS + 1).collect()
    if len(rows) > MAX_PUBLISHERS:
        raise ValueError(f"more than {MAX_PUBLISHERS} trusted publishers; use a hash allowlist instead")
    low = F.lower(F.trim(blank(signer)))
    return df.withColumn(out, contains_any(low, sorted(r[0].lower() for r in rows)) & (low != ""))


def with_feed_flags(events: DataFrame, feeds: Feeds) -> DataFrame:
    """All lookups an event may need, each a left join on the event's own key."""
    sha = F.when(F.col("event_type") == DOWNLOAD_TYPE, F.col("sha256")).otherwise(F.col("file_metadata.sha256"))
    out = with_reputation(events, feeds.hashes, sha, "hash")
    out = with_reputation(out, feeds.ips, "remote_ip", "ip")
    out = with_reputation(out, feeds.domains, "domain", "domain")
    return with_publisher(out, feeds.publishers, F.col("signature.signer"))

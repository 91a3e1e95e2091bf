"""Intelligence feeds as small tables: hash, address and domain blocklists, allowlists, publishers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.session import small_table

FEED_DDL = "indicator string, verdict string, threat_name string"
# Above this many rows a feed is joined by shuffle; below it the engine may broadcast it.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Feeds:
    """Feeds keyed by indicator; ``verdict`` is 'block' or 'allow'."""

    hashes: DataFrame
    ips: DataFrame
    domains: DataFrame
    publishers: DataFrame


def _table(spark: SparkSession, block: dict[str, str], allow: list[str] = ()) -> DataFrame:
    rows = [(k, "block", v) for k, v in block.items()] + [(k, "allow", None) for k in allow]
    return small_table(spark, rows, FEED_DDL)


def load_feeds(
    spark: SparkSession,
    *,
    hashes: DataFrame | None = None,
    ips: DataFrame | None = None,
    domains: DataFrame | None = None,
    publishers: DataFrame | None = None,
    trusted_hashes: list[str] = (),
) -> Feeds:
    """Default feeds, each replaceable by a table of ``indicator, verdict, threat_name``."""
    return Feeds(
        hashes=hashes if hashes is not None else _table(spark, V.BLOCKLIST_HASHES, list(trusted_hashes)),
        ips=ips if ips is not None else _table(spark, V.BLOCKLIST_IPS),
        domains=domains if domains is not None else _table(spark, V.BLOCKLIST_DOMAINS),
        publishers=publishers
        if publishers is not None
        else small_table(spark, [(p,) for p in V.TRUSTED_PUBLISHERS], "publisher string"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED_DDL).parquet(path)


def feed_lookup(feed: DataFrame) -> DataFrame:
    """One row per indicator: a blocklist entry wins over an allowlist entry of the same value."""
    block = F.col("verdict") == "block"
    return feed.groupBy("indicator").agg(
        F.bool_or(block).alias("is_blocklisted"),
        F.bool_or(F.col("verdict") == "allow").alias("is_listed_allow"),
        F.max(F.when(block, F.col("threat_name"))).alias("threat_name"),
    )

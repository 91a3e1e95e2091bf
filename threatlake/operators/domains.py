"""Registrable domains by public suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.text import staged
from threatlake.sources.suffixes import EXCEPTION, RULE, WILDCARD, deeper_table, max_labels, suffix_table

IPV4 = r"^(\d{1,3}\.){3}\d{1,3}\z"
IPV6 = r"(?i)^\[[0-9a-f:.]+\]\z"


def contains_ip(host: Column) -> Column:
    return host.rlike(IPV4) | host.rlike(IPV6)


def clean_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"\.\z", "")


def with_registrable(df: DataFrame, host: str, out: str = "registrable", suffix_flag: str | None = None) -> DataFrame:
    """Add the name one label below the longest public suffix (private suffixes included).

    One broadcast lookup per suffix length, all against the same small table: no shuffle, and rows
    stay where they are. A host that is itself a suffix, or an address, stands for itself.
    """
    spark = df.sparkSession
    name = clean_host(F.col(host))
    df = staged(df, {"__h": name, "__n": F.size(F.split(name, r"\."))})
    table = F.broadcast(suffix_table(spark))
    depth = max_labels()
    for k in range(1, depth + 1):
        key = F.when(F.col("__n") >= k, F.substring_index("__h", ".", -k))
        side = table.select(F.col("suffix").alias(f"__s{k}"), F.col("code").alias(f"__c{k}"))
        df = df.join(side, key == F.col(f"__s{k}"), "left").drop(f"__s{k}")
    exception = F.coalesce(
        *[F.when(F.col(f"__c{k}").bitwiseAND(EXCEPTION) != 0, k - 1) for k in range(depth, 1, -1)]
    )
    lengths = [F.lit(1)]
    for k in range(1, depth + 1):
        code = F.coalesce(F.col(f"__c{k}"), F.lit(0))
        lengths.append(F.when(code.bitwiseAND(RULE) != 0, k))
        lengths.append(F.when((code.bitwiseAND(WILDCARD) != 0) & (F.col("__n") > k), k + 1))
    df = df.withColumn("__len", F.coalesce(exception, F.greatest(*lengths)))
    ip = contains_ip(F.col("__h"))
    own = ip | (F.col("__n") <= F.col("__len"))
    below = F.expr("array_join(slice(split(__h, '[.]'), greatest(__n - __len, 1), __len + 1), '.')")
    added = {out: F.when(own, F.col("__h")).otherwise(below)}
    if suffix_flag:
        added[suffix_flag] = ~ip & (F.col("__n") <= F.col("__len"))
    return df.withColumns(added).drop("__h", "__n", "__len", *[f"__c{k}" for k in range(1, depth + 1)])


def with_deeper_suffixes(df: DataFrame, registrable: str, out: str = "suffixes_below") -> DataFrame:
    """Suffix rules under the registrable name, for ``same_site``; null for nearly every name."""
    side = F.broadcast(deeper_table(df.sparkSession)).select(F.col("name").alias("__d"), F.col("below").alias(out))
    return df.join(side, F.col(registrable) == F.col("__d"), "left").drop("__d")


def same_site(host: Column, registrable: Column, is_suffix: Column, below: Column) -> Column:
    """Whether ``host`` has the given registrable domain, without looking ``host`` up itself."""
    deeper = F.exists(
        F.coalesce(below, F.array().cast("array<string>")),
        lambda s: (host == s) | host.endswith(F.concat(F.lit("."), s)),
    )
    return (host == registrable) | (host.endswith(F.concat(F.lit("."), registrable)) & ~is_suffix & ~deeper)

"""Resolver-cache text dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


_NAME_LINE = r"(?:\A|[\r\n])\x20*(?=Record Name[^\r\n:]*:)"


def parse_dns_dumps(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, domain, ips, ttls`` per dump and record name.

    A dump is cut where a name line begins, and each block is read by itself: the work grows with the lines. A name that comes again is put together
    over its own blocks only. Repeated addresses count once, TTLs that are no integers are left out, and the "Record Type" line is not a record.
    """
    tagged = df.withColumn("_dump", F.monotonically_increasing_id())
    tagged = tagged.select(*keys, "_dump", F.posexplode(F.split(F.col(text), _NAME_LINE, -1)).alias("_pos", "_block"))
    lines = F.filter(
        F.transform(F.split("_block", r"\r\n|\r|\n"), lambda s: F.trim(s)),
        lambda s: (s != "") & ~s.startswith("---") & ~s.startswith("Windows IP Configuration") & s.contains(":"),
    )
    key, value = lambda s: F.trim(F.substring_index(s, ":", 1)), lambda s: F.trim(F.substr(s, F.instr(s, ":") + 1))
    is_ttl = lambda s: key(s).startswith("Time To Live")
    is_record = lambda s: key(s).contains("Record") & ~key(s).startswith("Record Type") & ~is_ttl(s) & (value(s) != "")
    blocks = tagged.withColumn("_lines", lines).where(F.get("_lines", F.lit(0)).startswith("Record Name"))
    rest = F.slice("_lines", F.lit(2), F.size("_lines"))
    facts = blocks.select(
        *keys, "_dump", "_pos", F.lower(F.rtrim(value(F.get("_lines", F.lit(0))), F.lit("."))).alias("domain"),
        F.transform(F.filter(rest, is_record), value).alias("ips"),
        F.array_compact(F.transform(F.filter(rest, lambda s: is_ttl(s) & value(s).rlike(r"^[+-]?\d+$")), lambda s: value(s).try_cast("int"))).alias("ttls"),
    ).where("domain <> ''")
    whole = facts.groupBy(*keys, "_dump", "domain").agg(F.array_sort(F.collect_list(F.struct("_pos", "ips", "ttls"))).alias("_b"))
    return whole.select(
        *keys, "domain", F.array_distinct(F.flatten(F.transform("_b", lambda b: b["ips"]))).alias("ips"),
        F.flatten(F.transform("_b", lambda b: b["ttls"])).alias("ttls"),
    )

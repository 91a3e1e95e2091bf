"""Mark-of-the-Web stream texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _field(content: Column, name: str, value: str) -> Column:
    """Value of the last ``name=value`` line."""
    hits = F.regexp_extract_all(content, F.lit(rf"(?m)^[ \t]*{name}={value}[ \t\r]*$"), F.lit(1))
    return F.try_element_at(hits, F.lit(-1))


def parse_zone_marks(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``zone_id, host_url, referrer_url, has_motw``; a mark exists once a zone number was read."""
    text = F.col(content)
    zone = _field(text, "ZoneId", r"[ \t]*([+-]?\d+)").try_cast("int")
    return df.withColumns(
        {
            "zone_id": zone,
            "host_url": F.trim(_field(text, "HostUrl", r"([^\r\n]*)")),
            "referrer_url": F.trim(_field(text, "ReferrerUrl", r"([^\r\n]*)")),
        }
    ).withColumn("has_motw", F.col("zone_id").isNotNull())

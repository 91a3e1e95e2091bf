"""Links whose visible text names another site than they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatlake.functions.text import blank
from threatlake.operators.urls import with_url_parts


def claimed_site(text):
    """Host that a link text starts with, without ``www.``; empty if it names none."""
    pattern = r"(?i)^(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,})(?:[/?#]|\z)"
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(text), pattern, 1)), r"^www\.", "")


def link_mismatch(df: DataFrame, text: str = "text", href: str = "href", out: str = "mismatch") -> DataFrame:
    """Add ``out``: the text claims a site that is neither the target host nor a parent of it."""
    parts = with_url_parts(df.withColumnRenamed(href, "__href"), "__href")
    real = F.regexp_replace(F.col("host"), r"^www\.", "")
    said = claimed_site(blank(text))
    wrong = (said != "") & (real != said) & ~real.endswith(F.concat(F.lit("."), said))
    flagged = parts.withColumn("__wrong", F.coalesce(wrong, F.lit(False)))
    keep = [c for c in df.columns if c != href]
    return flagged.select(*keep, F.col("__href").alias(href), F.col("__wrong").alias(out))

"""Public suffixes as a small lookup table.

The list is read at run time from the HTTP client library that ships with Spark; without it there are no results,
rather than different ones. Its size is that of the public list (about 10,000 rules), so the table may always be
broadcast. It is made once per session.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession

from threatlake.session import small_table

RULE, WILDCARD, EXCEPTION = 1, 2, 4


@functools.lru_cache(maxsize=1)
def suffix_rules() -> tuple[str, ...]:
    import pyspark

    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for home in filter(None, homes):
        for jar in sorted(glob.glob(os.path.join(home, "jars", "httpclient-*.jar"))):
            try:
                with zipfile.ZipFile(jar) as z, z.open("mozilla/public-suffix-list.txt") as f:
                    lines = f.read().decode("utf-8").splitlines()
            except (KeyError, OSError, zipfile.BadZipFile):
                continue
            return tuple(t.split()[0] for t in lines if t.strip() and not t.startswith("//"))
    raise FileNotFoundError("no public suffix list: Spark's jars hold no httpclient library")


@functools.lru_cache(maxsize=1)
def _codes() -> dict[str, int]:
    codes: dict[str, int] = {}
    for rule in suffix_rules():
        name, bit = rule, RULE
        if rule.startswith("!"):
            name, bit = rule[1:], EXCEPTION
        elif rule.startswith("*."):
            name, bit = rule[2:], WILDCARD
        for form in {name, name.encode("idna").decode() if not name.isascii() else name}:
            codes[form] = codes.get(form, 0) | bit
    return codes


@functools.lru_cache(maxsize=1)
def max_labels() -> int:
    return max(name.count(".") + 1 for name in _codes())


@functools.lru_cache(maxsize=1)
def _deeper() -> list[tuple[str, list[str]]]:
    """Names that are no suffix themselves but have suffix rules below them, with those rules."""
    codes, below = _codes(), {}
    for name in codes:
        labels = name.split(".")
        for i in range(1, len(labels) - 1):
            parent = ".".join(labels[i:])
            if not codes.get(parent, 0) & RULE:
                below.setdefault(parent, []).append(name)
    return sorted(below.items())


@functools.lru_cache(maxsize=4)
def suffix_table(spark: SparkSession) -> DataFrame:
    """``suffix, code``: bit 1 a rule, bit 2 parent of a wildcard rule, bit 4 an exception."""
    return small_table(spark, sorted(_codes().items()), "suffix string, code int")


@functools.lru_cache(maxsize=4)
def deeper_table(spark: SparkSession) -> DataFrame:
    """``name, below``: suffix rules that lie under a name which looks registrable."""
    return small_table(spark, _deeper(), "name string, below array<string>")

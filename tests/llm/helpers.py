"""Small tables with the awkward rows every operator has to stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, score double, ids string, "
    "part int, row int, gram long, label int, copies int, k1 long, text_hash long, component_id long"
)
EXTRA = 12  # columns after n_chars, whose names the operators use inside


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text[, source]), in three partitions, with clashing columns that hold nonsense."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", -1, -5, "x", 9.5, "y", 3, 4, 5, 6, 7, 8, 9, 10) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(words))

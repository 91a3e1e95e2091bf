"""Weighted signals and their noisy-OR combination."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threatlake.schemas import SIGNAL_DDL, SIGNALS_DDL
from threatlake.functions.text import as_col


def signal(id: Column | str, weight: Column | int, reason: Column | str, evidence: Column | None = None) -> Column:
    """One piece of evidence. Plain strings and numbers are literals here."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(id).cast("string").alias("id"),
        lit(weight).cast("int").alias("weight"),
        lit(reason).cast("string").alias("reason"),
        (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"),
    )


def signal_if(condition: Column, id, weight, reason, evidence: Column | None = None) -> Column:
    return F.when(condition, signal(id, weight, reason, evidence))


def signals_of(*candidates: Column) -> Column:
    """The candidates that fired, in order."""
    if not candidates:
        return no_signals()
    return F.array_compact(F.array(*candidates)).cast(SIGNALS_DDL)


def no_signals() -> Column:
    return F.array().cast(SIGNALS_DDL)


def union_signals(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, no_signals()) for a in arrays])


def last_per_id(signals: Column) -> Column:
    """Later signals replace earlier ones of the same id, at the earlier place."""
    ids = F.array_distinct(F.transform(signals, lambda s: s["id"]))
    return F.transform(ids, lambda i: F.try_element_at(F.filter(signals, lambda s: s["id"] == i), F.lit(-1)))


def by_weight(signals: Column) -> Column:
    """Heaviest first; equal weights keep their order."""
    keyed = F.transform(
        signals, lambda s, i: F.struct((-s["weight"]).alias("k"), i.alias("i"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def strongest_per_id(signals: Column, ties_by_id: bool = False) -> Column:
    """Keep the heaviest signal of each id, then order by weight (ties: id, or first seen)."""
    ids = F.array_distinct(F.transform(signals, lambda s: s["id"]))
    best = F.transform(
        ids, lambda i: F.try_element_at(by_weight(F.filter(signals, lambda s: s["id"] == i)), F.lit(1))
    )
    if not ties_by_id:
        return by_weight(best)
    keyed = F.transform(best, lambda s: F.struct((-s["weight"]).alias("k"), s["id"].alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def noisy_or(weights: Column, cap: int) -> Column:
    """``round((1 - prod(1 - min(w, cap) / 100)) * 100)`` in array order, rounding half up."""
    return F.aggregate(
        weights,
        F.lit(1.0),
        lambda miss, w: miss * (1 - F.least(w, F.lit(cap)) / F.lit(100.0)),
        lambda miss: F.floor((1 - miss) * 100 + 0.5).cast("int"),
    )


def score_weights(signals: Column) -> Column:
    """E-mail form: no replacement of equal ids, cap 99."""
    return noisy_or(F.transform(signals, lambda s: s["weight"]), 99)


def risk_level(score: Column | str) -> Column:
    score = as_col(score)
    return F.when(score >= 60, "dangerous").when(score >= 30, "suspicious").otherwise("safe")


def with_verdict(df, signals: str = "signals"):
    """Replace raw ``signals`` by the ordered unique list and add ``score``, ``level``, ``reasons``."""
    df = df.withColumn(signals, last_per_id(F.col(signals)))
    df = df.withColumn(signals, by_weight(F.col(signals)))
    df = df.withColumn("score", noisy_or(F.transform(F.col(signals), lambda s: s["weight"]), 95))
    return df.withColumns(
        {
            "level": risk_level("score"),
            "reasons": F.slice(F.transform(F.col(signals), lambda s: s["reason"]), 1, 5),
        }
    )


def signal_ids(signals: Column | str) -> Column:
    return F.array_join(F.transform(as_col(signals), lambda s: s["id"]), ",")


__all__ = [
    "SIGNAL_DDL", "signal", "signal_if", "signals_of", "no_signals", "union_signals", "last_per_id",
    "by_weight", "strongest_per_id", "noisy_or", "score_weights", "risk_level", "with_verdict", "signal_ids",
]

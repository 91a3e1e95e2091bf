"""Pluggable detectors: named builders of a signals column, guarded against bad output."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.signals import no_signals, with_verdict

KINDS = ("url", "text", "page")
REQUIRED = {"url": ["url"], "text": ["text"], "page": ["url", "text"]}
MAX_ID, MAX_TEXT = 128, 1_000


def signal_guard(signals: Column) -> Column:
    """Whether a detector's array is acceptable as a whole."""
    def fine(s: Column) -> Column:
        return (
            (F.trim(s["id"]) != "") & (F.length(s["id"]) <= MAX_ID)
            & s["weight"].between(0, 100)
            & (F.trim(s["reason"]) != "") & (F.length(s["reason"]) <= MAX_TEXT)
            & (s["evidence"].isNull() | (F.length(s["evidence"]) <= MAX_TEXT))
        )

    return signals.isNotNull() & F.forall(signals, lambda s: F.coalesce(fine(s), F.lit(False)))


def input_guard(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split scan inputs (``kind, url, text``) into usable rows and rejects."""
    ok = F.lit(False)
    for kind, fields in REQUIRED.items():
        test = F.col("kind") == kind
        for f in fields:
            test = test & F.col(f).isNotNull()
        ok = ok | test
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok), df.where(~ok)


class DetectorRegistry:
    """Detectors in order of registration.

    A builder takes the frame and returns it with one more column, a signals array; expressions,
    joins and Arrow functions are all welcome. Null or invalid arrays discard that detector's output
    for the row and are reported in ``failures``.
    """

    def __init__(self) -> None:
        self._detectors: list[tuple[str, tuple[str, ...], Callable[[DataFrame, str], DataFrame]]] = []

    def register(self, id: str, handles, build: Callable[[DataFrame, str], DataFrame]) -> DetectorRegistry:
        handles = tuple(handles)
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}", id or ""):
            raise TypeError(f"bad detector id {id!r}")
        if not handles or len(set(handles)) != len(handles) or not set(handles) <= set(KINDS):
            raise TypeError(f"detector {id!r} must handle distinct kinds of {KINDS}")
        if not callable(build):
            raise TypeError(f"detector {id!r} needs a builder")
        if any(d[0] == id for d in self._detectors):
            raise ValueError(f"detector {id!r} is registered twice")
        self._detectors.append((id, handles, build))
        return self

    def list(self) -> list[str]:
        return [d[0] for d in self._detectors]

    def scan(self, df: DataFrame) -> DataFrame:
        """Verdict and ``failures`` for rows with ``kind``."""
        parts, failures = [], []
        for i, (id, handles, build) in enumerate(self._detectors):
            col = f"__d{i}"
            df = build(df, col)
            wanted, good = F.col("kind").isin(*handles), signal_guard(F.col(col))
            parts.append(F.when(wanted & good, F.col(col)).otherwise(no_signals()))
            failures.append(F.when(wanted & ~good, F.lit(id)))
        df = df.withColumns(
            {"signals": F.concat(no_signals(), *parts), "failures": F.array_compact(F.array(*failures, F.lit(None).cast("string")))}
        ).drop(*[f"__d{i}" for i in range(len(self._detectors))])
        return with_verdict(df)

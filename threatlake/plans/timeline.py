"""The whole endpoint analysis: evaluated, correlated, suppressed and compacted, ranked per host."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatlake.fixed_values_endpoint import COOLDOWN_SECONDS, STORE_GAP_SECONDS
from threatlake.operators.correlate import with_correlations
from threatlake.operators.dedup import suppress
from threatlake.operators.evaluate import assess, with_findings
from threatlake.operators.store import to_store
from threatlake.session import put_down
from threatlake.sources.feeds import Feeds


def judged_events(observed: DataFrame, feeds: Feeds) -> DataFrame:
    """Observed events with rule findings, cross-event correlations and assessment."""
    return assess(with_correlations(observed, lambda events: with_findings(events, feeds)))


def threat_timeline(
    observed: DataFrame, feeds: Feeds, cooldown: int = COOLDOWN_SECONDS, gap: int = STORE_GAP_SECONDS
) -> DataFrame:
    """Merged store rows after suppression. The judged events are put down once, since suppression reads them twice."""
    return to_store(suppress(put_down(judged_events(observed, feeds)), cooldown), gap)


def host_ranking(timeline: DataFrame) -> DataFrame:
    """Hosts by their worst event and weight of findings."""
    return timeline.groupBy("host").agg(
        F.max("score").alias("max_score"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("severe"),
        F.count(F.lit(1)).alias("events"),
        F.sum("repeat_count").alias("observations"),
    )

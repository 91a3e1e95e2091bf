"""One result record per event: rule findings, in-event correlation, assessment and target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake import schemas as S
from threatlake.fixed_values_endpoint import THREAT_SCORE
from threatlake.functions.findings import RULES, brief, finding, findings_of, rules_column, sentence, with_assessment
from threatlake.functions.text import first_truthy
from threatlake.operators.reputation import with_feed_flags
from threatlake.operators.rules.network import corr_proc_net, dns_findings, download_findings, network_findings
from threatlake.operators.rules.persistence import persistence_findings, service_findings, task_findings
from threatlake.operators.rules.process import process_findings
from threatlake.sources.feeds import Feeds


def generic_findings() -> Column:
    kind = F.coalesce(F.col("event_type"), F.lit("unknown"))
    return findings_of(
        finding("GENERIC_EVENT_OBSERVED", "System event", "info", "informational",
                sentence("Event of type '{t}'.", t=kind), {"event_type": kind})
    )


def dispatch_findings(correlate: bool = True) -> Column:
    """Findings by event type. A lazy CASE: only the matching family is computed for a row."""
    kind = F.col("event_type")
    network = F.concat(network_findings(), corr_proc_net()) if correlate else network_findings()
    return (
        F.when(kind.isin(*S.PROCESS_TYPES), process_findings())
        .when(kind == S.NETWORK_TYPE, network)
        .when(kind == S.DNS_TYPE, dns_findings())
        .when(kind.isin(*S.AUTORUN_TYPES), persistence_findings())
        .when(kind.isin(*S.TASK_TYPES), task_findings())
        .when(kind.isin(*S.SERVICE_TYPES), service_findings())
        .when(kind == S.DOWNLOAD_TYPE, download_findings())
        .otherwise(generic_findings())
    )


def event_target() -> Column:
    return F.coalesce(
        first_truthy("process_name", "filename", "domain", "name", "task_name", "service_name"),
        F.lit("unknown"),
    )


def with_findings(events: DataFrame, feeds: Feeds) -> DataFrame:
    """Events with their feed flags, a ``findings`` array, and the rule ids and severities alone: readers take the one they need, and the
    other is not computed."""
    flagged = with_feed_flags(S.conform_events(events), feeds)
    with brief():
        rules = dispatch_findings()
    return flagged.withColumns({RULES: rules, "findings": dispatch_findings()})


def assess(df: DataFrame) -> DataFrame:
    """Score the findings of each row and add target and threat flag."""
    return with_assessment(df, rules_column(df)).withColumns(
        {"target": event_target(), "has_threats": F.col("score") >= THREAT_SCORE}
    )


def evaluate(events: DataFrame, feeds: Feeds) -> DataFrame:
    return assess(with_findings(events, feeds))

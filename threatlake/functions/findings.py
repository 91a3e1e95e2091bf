"""Findings, severities and the compound score of an event."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.fixed_values_endpoint import SEVERITY_FLOORS, SEVERITY_POINTS
from threatlake.functions.text import as_col, let
from threatlake.schemas import FINDINGS_DDL, RULES_DDL

SEVERITIES = ["critical", "high", "medium", "low", "info"]
#: Column with the rule id and severity of each of the ``findings``, in their order.
RULES = "_rules"
_BRIEF: ContextVar[bool] = ContextVar("brief", default=False)


@contextmanager
def brief() -> Iterator[None]:
    """Inside it the rules give the id and severity of what they find, without its wording and evidence: most readers need no more, and the
    sentences cost more than the tests."""
    token = _BRIEF.set(True)
    try:
        yield
    finally:
        _BRIEF.reset(token)


def findings_type() -> str:
    return RULES_DDL if _BRIEF.get() else FINDINGS_DDL


def rules_column(df: DataFrame) -> str:
    """The narrowest column of ``df`` that holds rule ids and severities."""
    return RULES if RULES in df.columns else "findings"


def as_rules(findings: Column | str) -> Column:
    return F.transform(as_col(findings), lambda f: F.struct(f["rule_id"].alias("rule_id"), f["severity"].alias("severity")))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def sentence(template: str, **values: Column) -> Column:
    """``template`` with ``{name}`` places filled from columns; nulls read as 'unknown'."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            parts.append(F.lit(head))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("unknown")))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def finding(rule_id: str, title, severity, confidence: str, reason, evidence: dict | None = None) -> Column:
    if _BRIEF.get():
        return F.struct(F.lit(rule_id).alias("rule_id"), _lit(severity).alias("severity"))
    pairs = []
    for key, value in (evidence or {}).items():
        pairs += [F.lit(key), _lit(value).cast("string")]
    evidence_map = F.create_map(*pairs) if pairs else F.create_map()
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        _lit(title).alias("title"),
        _lit(severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
        evidence_map.cast("map<string,string>").alias("evidence"),
        _lit(reason).alias("reason"),
        _lit(reason).alias("explanation"),
    )


def findings_of(*candidates: Column) -> Column:
    return F.array_compact(F.array(*candidates)).cast(findings_type())


def or_observed(found: Column, observed: Column) -> Column:
    """``found``, which is computed once, or the plain observation if it is empty."""
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(findings_of(observed)))


def no_findings() -> Column:
    return F.array().cast(findings_type())


def union_findings(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, no_findings()) for a in arrays])


def severity_points(severity: Column) -> Column:
    expr = F.when(severity == "critical", SEVERITY_POINTS["critical"])
    for name in ("high", "medium", "low"):
        expr = expr.when(severity == name, SEVERITY_POINTS[name])
    return expr.otherwise(0)


def severity_class(score: Column | str) -> Column:
    score = as_col(score)
    expr = None
    for floor, name in SEVERITY_FLOORS:
        expr = F.when(score >= floor, name) if expr is None else expr.when(score >= floor, name)
    return expr.otherwise("info")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), severity).cast("int")


def compound_score(points: Column) -> Column:
    """Heaviest finding plus a quarter (whole points) of every other, at most 100."""
    top = F.coalesce(F.array_max(points), F.lit(0))
    quarter = F.aggregate(points, F.lit(0), lambda acc, p: acc + F.floor(p * 0.25).cast("int"))
    return F.least(F.lit(100), top + quarter - F.floor(top * 0.25).cast("int"))


def _count_of(findings: Column, severity: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["severity"] == severity))


def score_findings(findings: Column) -> Column:
    """Assessment struct of one event's findings."""
    score = compound_score(F.transform(findings, lambda f: severity_points(f["severity"])))
    counts = {name: _count_of(findings, name) for name in SEVERITIES}
    pairs = []
    for name in SEVERITIES:
        pairs += [F.lit(name), counts[name]]
    listed = F.array_join(
        F.array_compact(
            F.array(
                *[
                    F.when(counts[s] > 0, F.concat(counts[s].cast("string"), F.lit(f" {s}")))
                    for s in ("critical", "high", "medium", "low")
                ]
            )
        ),
        ", ",
    )
    total = F.size(findings)
    summary = (
        F.when(total == 0, F.lit("No findings were produced."))
        .when(
            listed != "",
            F.concat(total.cast("string"), F.lit(" finding(s) ("), listed,
                     F.lit("); composite score is "), score.cast("string"), F.lit("/100.")),
        )
        .otherwise(
            F.concat(total.cast("string"), F.lit(" informational finding(s); highest rule-based score is "),
                     score.cast("string"), F.lit("/100."))
        )
    )
    return F.struct(
        score.alias("score"),
        severity_class(score).alias("severity"),
        summary.alias("summary"),
        total.alias("finding_count"),
        F.create_map(*pairs).alias("severity_counts"),
    )


def with_assessment(df: DataFrame, findings: str = "findings") -> DataFrame:
    df = df.withColumn("assessment", score_findings(F.coalesce(F.col(findings), F.array().cast(df.schema[findings].dataType))))
    return df.withColumns(
        {
            "score": F.col("assessment.score"),
            "severity": F.col("assessment.severity"),
            "summary": F.col("assessment.summary"),
        }
    )


def score_findings_agg(long: DataFrame, keys: list[str]) -> DataFrame:
    """The same score over exploded findings: one partial aggregation, no arrays, no collected groups."""
    points = severity_points(F.col("severity"))
    agg = long.groupBy(*keys).agg(
        F.max(points).alias("_top"),
        F.sum(F.floor(points * 0.25)).alias("_quarter"),
        F.count(F.lit(1)).alias("finding_count"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES],
    )
    score = F.least(
        F.lit(100), F.col("_top") + F.col("_quarter") - F.floor(F.col("_top") * 0.25)
    ).cast("int")
    return agg.withColumn("score", score).withColumn("severity", severity_class("score")).drop("_top", "_quarter")


def rule_ids(findings: Column | str) -> Column:
    return F.array_join(F.transform(as_col(findings), lambda f: f["rule_id"]), ",")

"""Decision tables: prevention policy, download verdicts, navigation blocking and its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake import fixed_values_phishing as P
from threatlake.functions.findings import rule_ids, rules_column
from threatlake.functions.scan import Bounds, prefix_scan
from threatlake.functions.text import blank, first_truthy, in_list, windows_parts


def plan_prevention(
    assessed: DataFrame, *, enabled: bool = True, mode: str = V.PREVENTION_MODE, min_score: int = V.PREVENTION_MIN_SCORE,
) -> DataFrame:
    """Add ``justified``, ``planned_actions`` and ``refusals``. Nothing is carried out."""
    mode = mode.lower()
    floor = max(0, min(100, int(min_score)))
    alarming = F.exists(
        rules_column(assessed), lambda f: (f["severity"] == "critical") | f["rule_id"].contains("BLOCKLIST")
    )
    justified = (F.lit(enabled) & ((F.col("score") >= floor) | alarming)) if enabled else F.lit(False)
    act = justified if mode != "alert_only" else F.lit(False)
    pid = F.coalesce(F.col("pid"), F.lit(0))
    file = first_truthy("file_path", "executable", "file_metadata.path")
    guarded_name = in_list(F.lower(blank("process_name")), V.PROTECTED_PROCESSES)
    guarded_pid = pid.isin(*V.PROTECTED_PIDS)
    guarded_file = F.coalesce(
        F.arrays_overlap(windows_parts(F.lower(file)), F.array(F.lit("system32"), F.lit("syswow64"))), F.lit(False)
    )
    wants_kill = act & (pid != 0) if "terminate" in mode else F.lit(False)
    wants_move = act & file.isNotNull() if "quarantine" in mode else F.lit(False)
    return assessed.withColumns(
        {
            "justified": justified,
            "planned_actions": F.array_join(
                F.array_compact(
                    F.array(
                        F.when(wants_kill & ~guarded_pid & ~guarded_name, F.lit("terminate_process")),
                        F.when(wants_move & ~guarded_file, F.lit("quarantine_file")),
                    )
                ),
                ",",
            ),
            "refusals": F.array_join(
                F.array_compact(
                    F.array(
                        F.when(wants_kill & guarded_pid, F.lit("critical-pid"))
                        .when(wants_kill & guarded_name, F.lit("protected-process")),
                        F.when(wants_move & guarded_file, F.lit("system-file")),
                    )
                ),
                ",",
            ),
        }
    )


def decide_downloads(assessed: DataFrame) -> DataFrame:
    """HIGH_RISK from score 50 or severity high on; expects ``planned_actions`` when prevention ran."""
    high = (F.col("score") >= 50) | F.col("severity").isin("high", "critical")
    acted = F.col("planned_actions") != "" if "planned_actions" in assessed.columns else F.lit(False)
    return assessed.withColumns(
        {
            "decision": F.when(high, "HIGH_RISK").otherwise("LOW_RISK"),
            "action": F.when(~high, "ALLOW_NORMAL_ACTIVITY")
            .when(acted, "ALERT_AND_PREVENTION_APPLIED")
            .otherwise("GENERATE_ALERT"),
            "evidence_count": F.size(rules_column(assessed)),
            "rules": rule_ids(rules_column(assessed)),
        }
    )


def block_threshold(sensitivity):
    return (
        F.when(sensitivity == "high", P.BLOCK_THRESHOLDS["high"])
        .when(sensitivity == "low", P.BLOCK_THRESHOLDS["low"])
        .otherwise(P.BLOCK_THRESHOLDS["medium"])
    )


def blocked(navigations: DataFrame) -> DataFrame:
    """Navigations whose ``score`` reaches the threshold of the user's ``sensitivity``."""
    return navigations.where(F.col("score") >= block_threshold(F.col("sensitivity")))


def not_allowlisted(navigations: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Navigations to hosts the user (``user_id, host``) has not allowlisted."""
    return navigations.join(allowlist.select("user_id", "host").distinct(), ["user_id", "host"], "left_anti")


def block_history(blocked_visits: DataFrame, items: int = P.HISTORY_ITEMS) -> DataFrame:
    """Newest ``items`` blocked visits per user, host name only, three reasons.

    A row-number filter: the engine keeps a per-group top-k before the shuffle (WindowGroupLimit), so
    a user with very many visits sends only ``items`` rows per task.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("seq"))
    return (
        blocked_visits.withColumn("item", F.row_number().over(newest))
        .where(F.col("item") <= items)
        .select("user_id", "item", "ts", "host", "score", "level", F.slice("reasons", 1, 3).alias("reasons"))
    )


def page_key(url):
    """URL without its fragment."""
    return F.regexp_replace(url, r"#.*$", "")


def consume_allow_once(events: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Visits with ``allowed``: the previous event of the same user and page was an approval.

    Approvals are a set, so repeated approvals before one visit count once, and a visit uses it up.
    Columns: ``user_id, url, kind ('approve' or 'visit'), ts, seq``.
    """
    usable = F.col("url").rlike("(?i)^https?://")
    keyed = events.withColumn("_page", F.when(usable, page_key(F.col("url"))))
    scanned = prefix_scan(
        keyed, ["user_id", "_page"], ["ts", "seq"], lasts={"_before": F.col("kind")}, inclusive=False,
        bounds=bounds,
    )
    ok = F.coalesce((F.col("_before") == "approve") & F.col("_page").isNotNull(), F.lit(False))
    return scanned.where(F.col("kind") == "visit").withColumn("allowed", ok).drop("_page", "_before")

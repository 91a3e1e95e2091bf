"""Autorun entries, scheduled tasks and services."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.functions.findings import finding, findings_of, or_observed, sentence
from threatlake.functions.text import blank, contains_any, let
from threatlake.operators.rules.common import command_pattern, names_writable_folder


def persistence_findings() -> Column:
    c = F.col
    name = F.coalesce(c("name"), F.lit("unknown"))
    command, where = blank(c("command")), blank(c("location"))
    pattern = lambda use: let(command_pattern(command), lambda d: F.when(d.isNotNull(), use(d)))
    found = findings_of(
        F.when(
            names_writable_folder(command),
            finding("PERSIST_WRITABLE_LOCATION", "Autorun entry starts a file from a user-writable folder",
                    "high", "medium",
                    sentence("Entry '{n}' in {w} starts {c} from a writable folder.", n=name, w=where, c=command)),
        ),
        pattern(lambda d: finding(
            "PERSIST_SUSPICIOUS_COMMAND", F.concat(F.lit("Autorun entry with suspicious arguments: "), d),
            "high", "medium", sentence("Entry '{n}' runs: {d}.", n=name, d=d))),
    )
    observed = finding("PERSIST_ITEM_OBSERVED", "Autorun entry registered",
                       F.when(c("event_type") == "startup_item_added", "low").otherwise("info"), "informational",
                       sentence("Entry '{n}' in {w} starts {c}.", n=name, w=where, c=command))
    removed = findings_of(
        finding("PERSIST_REMOVED", "Autorun entry removed", "info", "informational",
                sentence("Entry '{n}' left {w}.", n=name, w=where))
    )
    return F.when(c("event_type") == "startup_item_removed", removed).otherwise(or_observed(found, observed))


def task_findings() -> Column:
    c = F.col
    name = F.coalesce(c("task_name"), F.lit("unknown"))
    run = blank(c("task_to_run"))
    pattern = lambda use: let(command_pattern(run), lambda d: F.when(d.isNotNull(), use(d)))
    found = findings_of(
        F.when(
            names_writable_folder(run),
            finding("TASK_WRITABLE_LOCATION", "Scheduled task runs a file from a user-writable folder",
                    "high", "medium", sentence("Task '{n}' runs {r} from a writable folder.", n=name, r=run)),
        ),
        pattern(lambda d: finding(
            "TASK_SUSPICIOUS_COMMAND", F.concat(F.lit("Scheduled task with suspicious arguments: "), d),
            "high", "medium", sentence("Task '{n}' shows: {d}.", n=name, d=d))),
    )
    observed = finding("TASK_OBSERVED", "Scheduled task registered or changed",
                       F.when(c("event_type") == "scheduled_task_created", "low").otherwise("info"), "informational",
                       sentence("Task '{n}' runs {r}.", n=name, r=F.coalesce(F.nullif(run, F.lit("")), F.lit("(no action)"))))
    deleted = findings_of(
        finding("TASK_DELETED", "Scheduled task deleted", "info", "informational",
                sentence("Task '{n}' is gone.", n=name))
    )
    return F.when(c("event_type") == "scheduled_task_deleted", deleted).otherwise(or_observed(found, observed))


def service_findings() -> Column:
    c = F.col
    name = F.coalesce(c("name"), F.lit("unknown"))
    shown = F.coalesce(c("display_name"), name)
    path = blank(c("binpath"))
    found = findings_of(
        F.when(
            names_writable_folder(path),
            finding("SVC_WRITABLE_LOCATION", "Service binary in a user-writable folder", "high", "high",
                    sentence("Service '{s}' ({n}) starts {p} from a writable folder.", s=shown, n=name, p=path)),
        ),
        F.when(
            contains_any(F.lower(path), V.SHELL_CHILDREN),
            finding("SVC_SCRIPT_HOST", "Service starts a command interpreter", "high", "medium",
                    sentence("Service '{s}' starts an interpreter: {p}.", s=shown, p=path)),
        ),
    )
    observed = finding("SVC_OBSERVED", "Service observed",
                       F.when(c("event_type") == "service_installed", "low").otherwise("info"), "informational",
                       sentence("Service '{s}' ({n}) starts {p}.", s=shown, n=name, p=path))
    removed = findings_of(
        finding("SVC_REMOVED", "Service removed", "info", "informational",
                sentence("Service '{s}' ({n}) is gone.", s=shown, n=name))
    )
    return F.when(c("event_type") == "service_removed", removed).otherwise(or_observed(found, observed))

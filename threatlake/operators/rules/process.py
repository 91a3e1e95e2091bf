"""Process events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.functions.findings import finding, findings_of, findings_type, sentence
from threatlake.functions.text import base_name, blank, in_list, is_true, let
from threatlake.operators.rules.common import (
    command_pattern, double_extension, is_writable_path, lolbin_pattern, masquerading,
)

STRONG = [
    "THREAT_BLOCKLIST_HASH", "PROC_MASQUERADING", "PROC_DOUBLE_EXTENSION", "PROC_SUSPICIOUS_LOLBIN",
    "PROC_WRITABLE_LOCATION", "PROC_MONITOR_SIGNAL", "PROC_SUSPICIOUS_PARENT_OFFICE",
    "PROC_SUSPICIOUS_COMMAND_LINE",
]


def process_findings() -> Column:
    """Findings array of a process event (needs the hash and publisher lookups of ``with_feed_flags``)."""
    c = F.col
    name = F.lower(F.coalesce(F.nullif(c("process_name"), F.lit("")), F.lit("unknown")))
    shown = c("process_name")
    exe = F.nullif(c("executable"), F.lit(""))
    has_exe = exe.isNotNull()
    file = base_name(exe)
    sha = F.nullif(c("file_metadata.sha256"), F.lit(""))
    status = F.coalesce(F.when(c("signature.status") == "", F.lit("unknown")).otherwise(c("signature.status")), F.lit("unavailable"))
    status_low = F.lower(status)
    signer = c("signature.signer")
    message = blank(c("signature.message"))

    masked = F.when(
        has_exe & masquerading(name, exe),
        finding("PROC_MASQUERADING", "Core process name outside the system folders", "critical", "high",
                sentence("'{n}' runs from '{e}', where the genuine system process never lives.", n=name, e=exe),
                {"process_name": name, "executable": exe}),
    )
    doubled = F.when(
        has_exe & double_extension(file),
        finding("PROC_DOUBLE_EXTENSION", "Executable hides behind a document extension", "high", "high",
                sentence("'{f}' carries two extensions and poses as a document.", f=file),
                {"filename": file, "executable": exe}),
    )
    office = F.when(
        in_list(F.lower(c("parent_name")), V.OFFICE_PARENTS) & in_list(name, V.SHELL_CHILDREN),
        finding("PROC_SUSPICIOUS_PARENT_OFFICE", "Office program started a shell", "high", "high",
                sentence("{p} (PID {i}) started {n}, a usual step of macro malware.",
                         p=F.lower(c("parent_name")), i=c("parent_pid"), n=name),
                {"parent_name": F.lower(c("parent_name")), "parent_pid": c("parent_pid"), "child_name": name}),
    )
    lol = let(lolbin_pattern(c("command_line")), lambda d: F.when(
        d.isNotNull(),
        finding("PROC_SUSPICIOUS_LOLBIN", F.concat(F.lit("System tool misuse: "), d), "high", "high",
                sentence("{n} was run as: {d}.", n=name, d=d),
                {"command_line": c("command_line"), "pattern": d}),
    ))
    cmd = let(command_pattern(c("command_line")), lambda d: F.when(
        d.isNotNull(),
        finding("PROC_SUSPICIOUS_COMMAND_LINE", F.concat(F.lit("Suspicious arguments: "), d),
                F.when(F.lower(d).contains("shadow") | F.lower(d).contains("encoded"), "high").otherwise("medium"), "medium",
                sentence("{n} has arguments that show: {d}.", n=name, d=d),
                {"command_line": c("command_line"), "pattern": d}),
    ))
    hash_hit = (
        F.when(
            has_exe & sha.isNotNull() & is_true("hash_blocklisted"),
            finding("THREAT_BLOCKLIST_HASH", "Executable is a known malicious file", "critical", "high",
                    sentence("SHA-256 {h} is listed as {t}.", h=sha, t=c("hash_threat")),
                    {"sha256": sha, "executable": exe, "threat": c("hash_threat")}),
        )
        .when(
            has_exe & sha.isNotNull() & is_true("hash_allowlisted"),
            finding("PROC_ALLOWLISTED_HASH", "Executable is on the trusted list", "info", "informational",
                    sentence("SHA-256 {h} is on the trusted application list.", h=sha),
                    {"sha256": sha, "executable": exe}),
        )
    )
    writable = F.when(
        has_exe & (is_writable_path(exe) | is_true("file_metadata.is_writable_location")),
        finding("PROC_WRITABLE_LOCATION", "Executable in a user-writable folder", "medium", "low",
                sentence("{n} runs from {e}, a folder any user may write to.", n=shown, e=exe),
                {"executable": exe}),
    )
    trusted = is_true("trusted_publisher")
    signature = F.when(
        has_exe & (status_low == "valid"),
        finding("PROC_SIGNATURE_VALID",
                F.when(trusted, "Signed by a trusted publisher").otherwise("Valid signature"),
                "info", "informational",
                sentence("{n} has a valid signature of {s}; that proves origin, not safety.", n=shown, s=signer),
                {"signer": signer, "signature_status": "Valid", "is_trusted_publisher": trusted}),
    ).when(
        has_exe & status_low.isin(*V.REVIEW_SIGNATURES),
        finding("PROC_SIGNATURE_REVIEW", "Signature needs review", "low", "low",
                sentence("The signature status of {n} is {s}; not proof of harm by itself.", n=shown, s=status),
                {"signature_status": status, "message": message}),
    ).when(
        has_exe & (status_low == "unavailable"),
        finding("PROC_SIGNATURE_UNAVAILABLE", "Signature could not be checked", "info", "informational",
                sentence("No signature result exists for {n}.", n=shown),
                {"signature_status": "unavailable"}),
    ).when(
        has_exe,
        finding("PROC_SIGNATURE_STATUS_UNKNOWN", "Signature result is inconclusive", "info", "informational",
                sentence("The signature check of {n} returned {s}.", n=shown, s=status),
                {"signature_status": status}),
    )
    signals = F.transform(
        F.coalesce(c("reasons"), F.array().cast("array<string>")),
        lambda r: finding("PROC_MONITOR_SIGNAL", "Monitor reported a signal", "medium", "low", r, {"signal": r}),
    ).cast(findings_type())
    main = findings_of(masked, doubled, office, lol, cmd, hash_hit, writable, signature)

    def whole(found: Column) -> Column:
        has_strong = F.exists(found, lambda f: f["rule_id"].isin(*STRONG))
        observed = findings_of(
            F.when(
                has_exe & ~has_strong,
                finding("PROC_OBSERVED", "New process", "info", "informational",
                        sentence("{n} (PID {p}, parent {q}) started; no rule matched.",
                                 n=shown, p=c("pid"), q=c("parent_pid")),
                        {"process_name": shown, "pid": c("pid")}),
            )
        )
        no_path = findings_of(
            F.when(
                ~has_exe & (F.size(found) == 0),
                finding("PROC_PATH_UNAVAILABLE", "Executable path unknown", "info", "informational",
                        sentence("The path of {n} could not be read; usual for protected processes.", n=shown),
                        {"process_name": shown}),
            )
        )
        return F.concat(observed, found, no_path)

    ended = findings_of(
        finding("PROC_TERMINATED", "Process ended", "info", "informational",
                sentence("{n} (PID {p}) ended.", n=shown, p=c("pid")))
    )
    return F.when(c("event_type") == "process_terminated", ended).otherwise(let(F.concat(main, signals), whole))

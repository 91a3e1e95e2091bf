"""Network, DNS and download events, and the process/network correlation inside one event."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.functions.findings import finding, findings_of, or_observed, sentence
from threatlake.functions.text import blank, in_list, is_true
from threatlake.operators.rules.common import (
    double_extension, masquerading, mentions_writable_name, names_writable_folder,
)


def _endpoint() -> tuple[Column, Column, Column]:
    c = F.col
    return (
        F.coalesce(F.nullif(c("process_name"), F.lit("")), F.lit("unknown")),
        F.coalesce(F.nullif(c("remote_ip"), F.lit("")), F.lit("unknown")),
        c("remote_port"),
    )


def network_findings() -> Column:
    c = F.col
    process, ip, port = _endpoint()
    listed = is_true("ip_blocklisted")
    threat = F.when(listed, c("ip_threat")).otherwise(
        F.coalesce(F.nullif(c("threat_details"), F.lit("")), F.lit("Matches threat intelligence blocklist"))
    )
    place = F.when(blank(c("city")) != "", F.concat(c("city"), F.lit(", "), c("country"))).otherwise(c("country"))
    known_place = (blank(c("country")) != "") & (c("country") != V.LOCAL_COUNTRY)
    found = findings_of(
        F.when(
            is_true("threat_flagged") | listed,
            finding("NET_KNOWN_MALICIOUS_IP", "Connection to a malicious address", "critical", "high",
                    sentence("{p} reached {i}:{q}, listed as: {t}.", p=process, i=ip, q=port, t=threat),
                    {"remote_ip": ip, "threat": threat}),
        ),
        F.when(
            is_true("is_suspicious_client") & is_true("is_public_ip"),
            finding("NET_SUSPICIOUS_CLIENT_PROCESS", "Interpreter connected to the internet", "high", "high",
                    sentence("Interpreter {p} opened {i}:{q}, as reverse shells and staged downloads do.",
                             p=process, i=ip, q=port)),
        ),
        F.when(
            is_true("is_repeated_burst"),
            finding("NET_REPEATED_BURST", "Burst of connections", "medium", "medium",
                    sentence("{p} connected {n} times to {i}:{q}.", p=process,
                             n=F.coalesce(c("connection_count"), F.lit(1)), i=ip, q=port)),
        ),
        F.when(
            is_true("is_wide_fanout"),
            finding("NET_WIDE_FANOUT", "Many different destinations", "medium", "low",
                    sentence("{p} (PID {d}) reached many endpoints; may be scanning.", p=process, d=c("pid"))),
        ),
        F.when(
            is_true("is_hosting") & (blank(c("hosting_provider")) != ""),
            finding("NET_HOSTING_INFRASTRUCTURE", F.concat(F.lit("Remote server hosted by "), c("hosting_provider")),
                    "info", "informational",
                    sentence("{i} belongs to {h}; ordinary for web traffic.", i=ip, h=c("hosting_provider"))),
        ),
        F.when(
            known_place,
            finding("NET_FOREIGN_LOCATION", F.concat(F.lit("Remote host in "), place), "info", "informational",
                    sentence("{i} is in {l}; a foreign address is not harmful as such.", i=ip, l=place)),
        ),
    )
    observed = finding("NET_CONNECTION_OBSERVED", "Network connection", "info", "informational",
                       sentence("{p} connected to {i}:{q}.", p=process, i=ip, q=port))
    return or_observed(found, observed)


def corr_proc_net() -> Column:
    """Compound risks of a socket and the attributes of the process that owns it."""
    c = F.col
    name, exe = F.lower(blank(c("process_name"))), blank(c("executable"))
    ip, port = blank(c("remote_ip")), c("remote_port")
    flagged = is_true("threat_flagged") & (is_true("is_suspicious_client") | mentions_writable_name(exe))
    evidence = {"process_name": name, "executable": exe, "remote_ip": ip, "remote_port": port}
    return findings_of(
        F.when(
            flagged,
            finding("CORR_SUSPICIOUS_PROC_MALICIOUS_IP", "Suspicious process talks to a flagged address",
                    "critical", "high",
                    sentence("{n} from '{e}' reached flagged {i}:{q}.", n=name, e=exe, i=ip, q=port),
                    {**evidence, "threat_details": c("threat_details")}),
        ),
        F.when(
            names_writable_folder(exe) & is_true("is_public_ip"),
            finding("CORR_WRITABLE_EXEC_OUTBOUND", "Executable in a writable folder reached the internet",
                    "high", "high",
                    sentence("{n} from '{e}' opened public {i}:{q}.", n=name, e=exe, i=ip, q=port), evidence),
        ),
        F.when(
            is_true("is_suspicious_client") & is_true("is_public_ip") & ~flagged,
            finding("CORR_SHELL_INTERNET_COMMUNICATION", "Shell reached the internet", "high", "high",
                    sentence("Shell {n} opened {i}:{q}.", n=name, i=ip, q=port),
                    {"process_name": name, "remote_ip": ip, "remote_port": port}),
        ),
    )


def dns_findings() -> Column:
    c = F.col
    domain = F.coalesce(F.nullif(c("domain"), F.lit("")), F.lit("unknown"))
    found = findings_of(
        F.when(
            is_true("domain_blocklisted"),
            finding("DNS_BLOCKLISTED_DOMAIN", "Query for a blocklisted domain", "critical", "high",
                    sentence("'{d}' is listed as {t}.", d=domain, t=c("domain_threat")),
                    {"domain": domain, "threat": c("domain_threat")}),
        ),
        F.when(
            is_true("is_dynamic_dns"),
            finding("DNS_DYNAMIC_DNS", "Dynamic DNS name", "medium", "medium",
                    sentence("'{d}' is served by a dynamic DNS provider.", d=domain)),
        ),
        F.when(
            is_true("is_potential_dga"),
            finding("DNS_POTENTIAL_DGA", "Possibly generated name", "medium", "medium",
                    sentence("'{d}' looks generated (entropy {e}).", d=domain, e=c("entropy"))),
        ),
        F.when(
            is_true("is_suspicious_tld"),
            finding("DNS_SUSPICIOUS_TLD", "Often abused domain ending", "low", "low",
                    sentence("'{d}' has an ending common in spam.", d=domain)),
        ),
    )
    ips = F.array_join(F.slice(F.coalesce(c("resolved_ips"), F.array().cast("array<string>")), 1, 3), ", ")
    observed = finding("DNS_QUERY_OBSERVED", "DNS query", "info", "informational",
                       F.concat(F.lit("Resolved '"), domain, F.lit("'"),
                                F.when(ips != "", F.concat(F.lit(" to "), ips)).otherwise(F.lit("")), F.lit(".")))
    return or_observed(found, observed)


def download_findings() -> Column:
    c = F.col
    file, path = blank(c("filename")), blank(c("file_path"))
    sha = F.lower(blank(c("sha256")))
    status = F.lower(F.coalesce(c("signature.status"), F.lit("unavailable")))
    signer = blank(c("signature.signer"))
    ext = F.lower(F.coalesce(F.nullif(c("extension"), F.lit("")), F.regexp_extract(file, r"[^.](\.[^.]*)$", 1)))
    marked = is_true("mark_of_the_web") | is_true(c("zone_id") == 3)
    allowed = (sha != "") & is_true("hash_on_allowlist")
    found = findings_of(
        F.when(
            (sha != "") & is_true("hash_blocklisted"),
            finding("DOWNLOAD_HASH_BLOCKLIST", "Download is a known malicious file", "critical", "high",
                    sentence("'{f}' matches the hash blocklist ({h}).", f=file, h=sha),
                    {"sha256": sha, "filename": file, "file_path": path}),
        ),
        F.when(
            allowed,
            finding("DOWNLOAD_HASH_ALLOWLIST", "Download is a known harmless file", "info", "high",
                    sentence("'{f}' is on the hash allowlist.", f=file), {"sha256": sha, "filename": file}),
        ).when(
            (signer != "") & is_true("trusted_publisher"),
            finding("DOWNLOAD_TRUSTED_PUBLISHER", F.concat(F.lit("Signed by trusted publisher "), signer),
                    "info", "high", sentence("'{f}' is signed by {s}.", f=file, s=signer),
                    {"signer": signer, "filename": file}),
        ),
        F.when(
            (file != "") & double_extension(file),
            finding("DOWNLOAD_DOUBLE_EXTENSION", "Download hides behind a document extension", "critical", "high",
                    sentence("'{f}' carries two extensions.", f=file), {"filename": file, "file_path": path}),
        ),
        F.when(
            (file != "") & masquerading(file, path),
            finding("DOWNLOAD_MASQUERADING", "Download has the name of a system process", "high", "high",
                    sentence("'{f}' takes a system name but was saved as {p}.", f=file, p=path),
                    {"filename": file, "file_path": path}),
        ),
        F.when(
            in_list(status, V.BROKEN_SIGNATURES),
            finding("DOWNLOAD_INVALID_SIGNATURE", "Download has a broken signature", "high", "high",
                    sentence("The signature of '{f}' is broken.", f=file), {"status": status, "filename": file}),
        ).when(
            in_list(ext, V.UNSIGNED_SENSITIVE_EXTENSIONS) & (status == "unsigned"),
            finding("DOWNLOAD_UNSIGNED_EXECUTABLE", "Downloaded program is unsigned", "medium", "medium",
                    sentence("'{f}' has no signature.", f=file), {"extension": ext, "filename": file}),
        ),
        F.when(
            in_list(ext, V.PAYLOAD_EXTENSIONS) & marked,
            finding("DOWNLOAD_SUSPICIOUS_PAYLOAD", F.concat(F.lit("Script or container from the internet: "), ext),
                    "medium", "medium", sentence("'{f}' is a script or container from the internet.", f=file),
                    {"extension": ext, "filename": file, "mark_of_the_web": c("mark_of_the_web"), "zone_id": c("zone_id")}),
        ),
        F.when(
            marked,
            finding("DOWNLOAD_MOTW_INTERNET", "File carries the internet zone mark", "info", "high",
                    sentence("'{f}' came from zone {z}.", f=file, z=c("zone_id")),
                    {"filename": file, "zone_id": c("zone_id"), "download_url": c("download_url")}),
        ),
    )
    observed = finding("DOWNLOAD_OBSERVED", "Downloaded file", "info", "informational",
                       sentence("'{f}' appeared in a download folder.", f=file), {"filename": file, "file_path": path})
    return or_observed(found, observed)

"""Check SQL for the endpoint queries, written independently of the Spark expressions."""

from __future__ import annotations

from threatlake.catalog.fixtures import TELEMETRY
from threatlake.fixed_values_endpoint import (
    ABUSED_DNS_TLDS, BLOCKLIST_DOMAINS, BLOCKLIST_HASHES, BLOCKLIST_IPS, COMMAND_PATTERNS, CORE_PROCESSES,
    DOUBLE_EXTENSION, DYNAMIC_DNS, HOSTING_PATTERNS, LOLBIN_PATTERNS, OFFICE_PARENTS, PAYLOAD_EXTENSIONS,
    PROTECTED_PROCESSES, SHELL_CHILDREN, SUSPICIOUS_CLIENTS, TRUSTED_PUBLISHERS, WRITABLE_DIRS,
)

POINTS = {"info": 0, "low": 15, "medium": 35, "high": 60, "critical": 85}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def matches(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)}, 'i')"


def any_of(col: str, table) -> str:
    return "(" + " OR ".join(matches(col, p) for p, _ in table) + ")"


def listed(rules: list[tuple[str, str, str]]) -> tuple[str, str]:
    """SQL lists (ids, severities) of the rules whose condition holds, in order."""
    ids = ", ".join(f"CASE WHEN {cond} THEN {q(rid)} END" for cond, rid, _ in rules)
    sev = ", ".join(
        f"CASE WHEN {cond} THEN {s if s.startswith('CASE') else q(s)} END" for cond, _, s in rules
    )
    keep = "lambda x: x IS NOT NULL"
    return f"list_filter([{ids}], {keep})", f"list_filter([{sev}], {keep})"


def or_else(rules, rid: str, sev: str) -> tuple[str, str]:
    ids, sevs = listed(rules)
    s = sev if sev.startswith("CASE") else q(sev)
    return (
        f"CASE WHEN len({ids}) > 0 THEN {ids} ELSE [{q(rid)}] END",
        f"CASE WHEN len({ids}) > 0 THEN {sevs} ELSE [{s}] END",
    )


TELE = "tele AS (SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM (" + TELEMETRY.format(events="events") + "))"

WRITABLE_PART = "(^|[\\\\/])(" + "|".join(WRITABLE_DIRS) + ")([\\\\/]|$)"
WRITABLE_INSIDE = "(\\\\(" + "|".join(WRITABLE_DIRS) + ")\\\\|/(" + "|".join(WRITABLE_DIRS) + ")/)"
PUBLIC = (
    "(NOT regexp_matches(remote_ip, '^10[.]') AND remote_ip NOT LIKE '198.51.100.%')"
)
SIGNED = "lower(signature_status)"
TRUSTED = "(" + " OR ".join(f"contains(lower(signer), {q(p.lower())})" for p in TRUSTED_PUBLISHERS) + ")"
DIR = "lower(regexp_replace(executable, '\\\\[^\\\\]*$', ''))"
FILE_DIR = "lower(regexp_replace(file_path, '\\\\[^\\\\]*$', ''))"
SYSTEM = "('c:\\windows\\system32', 'c:\\windows\\syswow64')"
HAS_EXE = "executable <> ''"
COMMAND_LABEL = "CASE " + " ".join(f"WHEN {matches('command_line', p)} THEN {q(d)}" for p, d in COMMAND_PATTERNS) + " END"

_proc = [
    (f"{HAS_EXE} AND lower(process_name) IN {names(CORE_PROCESSES)} AND {DIR} NOT IN {SYSTEM}", "PROC_MASQUERADING", "critical"),
    (f"{HAS_EXE} AND {matches('process_name', DOUBLE_EXTENSION)}", "PROC_DOUBLE_EXTENSION", "high"),
    (f"parent_name IN {names(OFFICE_PARENTS)} AND lower(process_name) IN {names(SHELL_CHILDREN)}", "PROC_SUSPICIOUS_PARENT_OFFICE", "high"),
    (any_of("command_line", LOLBIN_PATTERNS), "PROC_SUSPICIOUS_LOLBIN", "high"),
    (any_of("command_line", COMMAND_PATTERNS), "PROC_SUSPICIOUS_COMMAND_LINE",
     f"CASE WHEN regexp_matches({COMMAND_LABEL}, 'shadow|encoded', 'i') THEN 'high' ELSE 'medium' END"),
    (f"{HAS_EXE} AND lower(sha256) IN {names(BLOCKLIST_HASHES)}", "THREAT_BLOCKLIST_HASH", "critical"),
    (f"{HAS_EXE} AND regexp_matches(lower(executable), {q(WRITABLE_PART)})", "PROC_WRITABLE_LOCATION", "medium"),
]
_sig = [
    (f"{HAS_EXE} AND {SIGNED} = 'valid'", "PROC_SIGNATURE_VALID", "info"),
    (f"{HAS_EXE} AND {SIGNED} IN ('notsigned', 'hashmismatch')", "PROC_SIGNATURE_REVIEW", "low"),
    (f"{HAS_EXE} AND {SIGNED} = 'unavailable'", "PROC_SIGNATURE_UNAVAILABLE", "info"),
    (f"{HAS_EXE} AND {SIGNED} IN ('unsigned', 'invalid')", "PROC_SIGNATURE_STATUS_UNKNOWN", "info"),
]
_strong = " OR ".join(f"({c})" for c, _, _ in _proc)
PROCESS = listed(
    [(f"{HAS_EXE} AND NOT ({_strong})", "PROC_OBSERVED", "info"), *_proc, *_sig,
     (f"NOT ({HAS_EXE}) AND NOT ({_strong})", "PROC_PATH_UNAVAILABLE", "info")]
)


def _persist(prefix: str, added: str, extra: list, observed: str) -> tuple[str, str]:
    rules = [(f"regexp_matches(lower(command), {q(WRITABLE_INSIDE)})", f"{prefix}_WRITABLE_LOCATION", "high"), *extra]
    return or_else(rules, observed, f"CASE WHEN event_type = {q(added)} THEN 'low' ELSE 'info' END")


AUTORUN = _persist("PERSIST", "startup_item_added", [(any_of("command", COMMAND_PATTERNS), "PERSIST_SUSPICIOUS_COMMAND", "high")], "PERSIST_ITEM_OBSERVED")
TASK = _persist("TASK", "scheduled_task_created", [(any_of("command", COMMAND_PATTERNS), "TASK_SUSPICIOUS_COMMAND", "high")], "TASK_OBSERVED")
SERVICE = _persist(
    "SVC", "service_installed",
    [("(" + " OR ".join(f"contains(lower(command), {q(n)})" for n in SHELL_CHILDREN) + ")", "SVC_SCRIPT_HOST", "high")],
    "SVC_OBSERVED",
)
FLAGGED = f"remote_ip IN {names(BLOCKLIST_IPS)}"
CLIENT = f"lower(process_name) IN {names(SUSPICIOUS_CLIENTS)}"
HOSTED = any_of("concat(org, ' ', asn)", HOSTING_PATTERNS)
NETWORK = or_else(
    [
        (FLAGGED, "NET_KNOWN_MALICIOUS_IP", "critical"),
        (f"{CLIENT} AND {PUBLIC}", "NET_SUSPICIOUS_CLIENT_PROCESS", "high"),
        ("connection_count >= 5", "NET_REPEATED_BURST", "medium"),
        ("unique_destinations >= 8", "NET_WIDE_FANOUT", "medium"),
        (HOSTED, "NET_HOSTING_INFRASTRUCTURE", "info"),
        ("country <> 'Local / Private'", "NET_FOREIGN_LOCATION", "info"),
    ],
    "NET_CONNECTION_OBSERVED", "info",
)
_mention = "(" + " OR ".join(f"contains(lower(executable), {q(d)})" for d in WRITABLE_DIRS) + ")"
_corr1 = f"({FLAGGED} AND ({CLIENT} OR {_mention}))"
CORR = listed(
    [
        (_corr1, "CORR_SUSPICIOUS_PROC_MALICIOUS_IP", "critical"),
        (f"regexp_matches(lower(executable), {q(WRITABLE_INSIDE)}) AND {PUBLIC}", "CORR_WRITABLE_EXEC_OUTBOUND", "high"),
        (f"{CLIENT} AND {PUBLIC} AND NOT {_corr1}", "CORR_SHELL_INTERNET_COMMUNICATION", "high"),
    ]
)
CLEAN = "rtrim(lower(trim(domain)), '.')"
LABEL = f"split_part({CLEAN}, '.', 1)"
ENTROPY = (
    f"round(-list_sum(list_transform(list_sort(list_distinct(string_split({LABEL}, ''))), lambda c: "
    f"(len({LABEL}) - len(replace({LABEL}, c, '')))::DOUBLE / len({LABEL}) * "
    f"log2((len({LABEL}) - len(replace({LABEL}, c, '')))::DOUBLE / len({LABEL})))), 3)"
)
DYNAMIC = f"({CLEAN} IN {names(DYNAMIC_DNS)} OR " + " OR ".join(f"suffix({CLEAN}, {q('.' + d)})" for d in DYNAMIC_DNS) + ")"
ABUSED = "(" + " OR ".join(f"suffix({CLEAN}, {q(t)})" for t in ABUSED_DNS_TLDS) + ")"
DGA = (
    f"(len({LABEL}) >= 12 AND ({ENTROPY} >= 3.6 OR (len(regexp_replace({LABEL}, '[^aeiou]', '', 'g'))::DOUBLE / len({LABEL}) < 0.15 "
    f"AND regexp_matches({LABEL}, '[0-9]') AND regexp_matches({LABEL}, '[a-z]'))))"
)
DNS = or_else(
    [
        (f"{CLEAN} IN {names(BLOCKLIST_DOMAINS)}", "DNS_BLOCKLISTED_DOMAIN", "critical"),
        (DYNAMIC, "DNS_DYNAMIC_DNS", "medium"),
        (DGA, "DNS_POTENTIAL_DGA", "medium"),
        (ABUSED, "DNS_SUSPICIOUS_TLD", "low"),
    ],
    "DNS_QUERY_OBSERVED", "info",
)
_marked = "zone_id = 3"
DOWNLOAD = or_else(
    [
        (f"lower(sha256) IN {names(BLOCKLIST_HASHES)}", "DOWNLOAD_HASH_BLOCKLIST", "critical"),
        (TRUSTED, "DOWNLOAD_TRUSTED_PUBLISHER", "info"),
        (matches("filename", DOUBLE_EXTENSION), "DOWNLOAD_DOUBLE_EXTENSION", "critical"),
        (f"lower(filename) IN {names(CORE_PROCESSES)} AND {FILE_DIR} NOT IN {SYSTEM}", "DOWNLOAD_MASQUERADING", "high"),
        (f"{SIGNED} = 'invalid'", "DOWNLOAD_INVALID_SIGNATURE", "high"),
        (f"{SIGNED} = 'unsigned' AND extension IN ('.exe', '.dll', '.sys')", "DOWNLOAD_UNSIGNED_EXECUTABLE", "medium"),
        (f"extension IN {names(PAYLOAD_EXTENSIONS)} AND {_marked}", "DOWNLOAD_SUSPICIOUS_PAYLOAD", "medium"),
        (_marked, "DOWNLOAD_MOTW_INTERNET", "info"),
    ],
    "DOWNLOAD_OBSERVED", "info",
)


def by_type(i: int) -> str:
    one = lambda rid: f"[{q(rid)}]" if i == 0 else "['info']"
    net = f"list_concat({NETWORK[i]}, {CORR[i]})"
    return f"""CASE
      WHEN event_type = 'process_terminated' THEN {one('PROC_TERMINATED')}
      WHEN event_type = 'process_started' THEN {PROCESS[i]}
      WHEN event_type = 'network_connection_observed' THEN {net}
      WHEN event_type = 'dns_query_observed' THEN {DNS[i]}
      WHEN event_type = 'startup_item_removed' THEN {one('PERSIST_REMOVED')}
      WHEN event_type = 'startup_item_added' THEN {AUTORUN[i]}
      WHEN event_type = 'scheduled_task_created' THEN {TASK[i]}
      WHEN event_type = 'service_installed' THEN {SERVICE[i]}
      WHEN event_type = 'file_download_observed' THEN {DOWNLOAD[i]}
      ELSE {one('GENERIC_EVENT_OBSERVED')} END"""


GEN = """lives AS (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'process_terminated' THEN 1 ELSE 0 END) OVER
    (PARTITION BY host, pid ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS generation FROM tele)"""
STATS = """net0 AS (SELECT *, row_number() OVER (PARTITION BY host, pid, generation, remote_ip, remote_port ORDER BY ts, seq) AS rn,
    count(*) OVER (PARTITION BY host, pid, generation, remote_ip ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS connection_count
    FROM lives WHERE event_type = 'network_connection_observed'),
  net AS (SELECT *, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER
    (PARTITION BY host, pid, generation ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unique_destinations FROM net0)"""
ENRICHED = """enriched AS (SELECT t.*, coalesce(n.connection_count, 1) AS connection_count, coalesce(n.unique_destinations, 1) AS unique_destinations
    FROM tele t LEFT JOIN net n ON t.seq = n.seq)"""
POINT = "lambda s: CASE s WHEN 'critical' THEN 85 WHEN 'high' THEN 60 WHEN 'medium' THEN 35 WHEN 'low' THEN 15 ELSE 0 END"


def score_of(sevs: str) -> str:
    return (
        f"CAST(least(100, coalesce(list_max(list_transform({sevs}, {POINT})), 0)"
        f" + coalesce(list_sum(list_transform(list_transform({sevs}, {POINT}), lambda p: CAST(floor(p * 0.25) AS BIGINT))), 0)"
        f" - CAST(floor(coalesce(list_max(list_transform({sevs}, {POINT})), 0) * 0.25) AS BIGINT)) AS BIGINT)"
    )


def class_of(score: str) -> str:
    return f"CASE WHEN {score} >= 85 THEN 'critical' WHEN {score} >= 60 THEN 'high' WHEN {score} >= 35 THEN 'medium' WHEN {score} >= 15 THEN 'low' ELSE 'info' END"


JUDGED = f"""judged AS (SELECT *, {by_type(0)} AS ids, {by_type(1)} AS sevs FROM enriched)"""
SCORED0 = f"""scored0 AS (SELECT *, {score_of('sevs')} AS score FROM judged)"""
SCORED = f"""scored AS (SELECT *, {class_of('score')} AS severity,
  CASE WHEN event_type LIKE 'startup_item%' OR event_type LIKE 'scheduled_task%' OR event_type LIKE 'service_%' THEN name END AS item FROM scored0)"""
ALL = f"WITH {TELE}, {GEN}, {STATS}, {ENRICHED}, {JUDGED}, {SCORED0}, {SCORED}"


def family(ids_sevs: tuple[str, str], where: str) -> str:
    ids, sevs = ids_sevs
    return f"""WITH {TELE}, {GEN}, {STATS}, {ENRICHED},
      j AS (SELECT seq, {ids} AS ids, {sevs} AS sevs FROM enriched WHERE {where})
      SELECT seq, array_to_string(ids, ',') AS rules, {score_of('sevs')} AS score FROM j"""


FINGERPRINT_EVENT = (
    "sha256(concat(event_type, '|', lower(CASE WHEN executable <> '' THEN executable ELSE process_name END), '|', remote_ip, '|', "
    "CAST(remote_port AS VARCHAR), '|', array_to_string(list_sort(ids), ',')))"
)
STORE = f"""printed AS (SELECT *, {FINGERPRINT_EVENT} AS fingerprint FROM scored),
  gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host, fingerprint ORDER BY ts, seq) <= {{gap}}000000 THEN 0 ELSE 1 END AS fresh FROM printed),
  sessions AS (SELECT *, sum(fresh) OVER (PARTITION BY host, fingerprint ORDER BY ts, seq) AS s FROM gaps),
  store AS (SELECT host, fingerprint, arg_min(seq, struct_pack(a := ts, b := seq)) AS id, arg_min(event_type, struct_pack(a := ts, b := seq)) AS event_type,
    CAST(max(score) AS BIGINT) AS score, arg_max(severity, struct_pack(a := score, b := -epoch_us(ts), c := -seq)) AS severity,
    count(*) AS repeat_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM sessions GROUP BY host, fingerprint, s)"""
STORED = ALL + ", " + STORE

"""Registered queries of the endpoint analytics, each with its check SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.catalog import endpoint_oracle as O
from threatlake.catalog.fixtures import tables, telemetry, telemetry_with
from threatlake.catalog.registry import Catalog, as_long
from threatlake.functions.findings import RULES, rule_ids, score_findings_agg, with_assessment
from threatlake.functions.text import base_name, blank, size_label
from threatlake.operators import correlate, decisions, dedup, dns, evaluate, network, reputation, snapshots, store
from threatlake.operators.rules import common
from threatlake.schemas import DNS_TYPE, DOWNLOAD_TYPE, NETWORK_TYPE
from threatlake.session import cut_lineage
from threatlake.sources.feeds import load_feeds

catalog = Catalog()
query = catalog.query
GAP = 200_000


def monitored(ev: DataFrame) -> DataFrame:
    """Events with the columns that the monitors read off a row alone. Each monitor looks at the events of its own type."""
    net, names = F.col("event_type") == NETWORK_TYPE, F.col("event_type") == DNS_TYPE
    ev = network.with_hosting(network.with_ip_class(ev, only=net), only=net)
    return dns.dns_domain_features(ev, only=names).withColumns(
        {"is_suspicious_client": network.is_suspicious_client(F.col("process_name")), "threat_flagged": F.col("remote_ip").isin(*V.BLOCKLIST_IPS)}
    )


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry with the columns the monitors add: address class, tracker counts, DNS features."""
    stats = network.with_connection_stats(telemetry(spark, sf))
    stats = stats.select("seq", "connection_count", "is_repeated_burst", "is_wide_fanout")
    return monitored(telemetry_with(spark, sf, stats))


def judged(spark: SparkSession, sf: str, *types: str) -> DataFrame:
    ev = observed(spark, sf)
    if types:
        ev = ev.where(F.col("event_type").isin(*types))
    return evaluate.evaluate(ev, load_feeds(spark))


def family(builder, *types: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ev = observed(spark, sf).where(F.col("event_type").isin(*types))
        out = with_assessment(reputation.with_feed_flags(ev, load_feeds(spark)).withColumn("findings", builder()))
        return as_long(out.select("seq", rule_ids("findings").alias("rules"), "score"))

    return run


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Store of the evaluated telemetry with a deterministic outbox state."""
    s = store.to_store(judged(spark, sf), GAP)
    return s.withColumns(
        {
            "sync_status": F.when(F.col("id") % 3 == 0, "synced").when(F.col("id") % 3 == 1, "failed").otherwise("pending"),
            "retry_count": (F.col("id") % 7).cast("int"),
        }
    )


_SYNC = "CASE id % 3 WHEN 0 THEN 'synced' WHEN 1 THEN 'failed' ELSE 'pending' END"
_STORE = O.STORED.format(gap=GAP)
_OUTBOX = f", outbox AS (SELECT *, {_SYNC} AS sync_status, id % 7 AS retry_count FROM store)"


def _store_row(df: DataFrame) -> DataFrame:
    return as_long(df.select(
        "id", "host", "event_type", "severity", "score", "repeat_count",
        F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us")))


_STORE_COLS = "id, host, event_type, severity, score, repeat_count, first_us, last_us"

# --- sources ----------------------------------------------------------------------------------------


@query("src_events", """SELECT event_id AS seq, epoch_us(ts) AS ts_us, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def src_events(spark, sf):
    from threatlake.sources.events import read_events

    ev = read_events(spark, f"{sf}/events.parquet", id_column="event_id", props_column="props")
    return ev.select("seq", F.unix_micros("ts").alias("ts_us"), "event_type", F.col("extra")["k"].cast("bigint").alias("k"))


_DUMP = """SELECT CAST(floor(event_id / 20) AS BIGINT) AS dump_id,
  concat('h', CAST(min(user_id) % 10 AS STRING)) AS host,
  concat('Windows IP Configuration', chr(10), chr(10), {agg}) AS text
FROM {{events}} GROUP BY CAST(floor(event_id / 20) AS BIGINT)"""
_ENTRY = """concat('    Record Name . . . . . : Cdn', CAST(event_id % 4 AS STRING), '.Example.COM.', chr(10), '    Record Type . . . . . : 1', chr(10),
  '    Time To Live  . . . . : ', CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id % 300 AS STRING) END, chr(10),
  '    A (Host) Record . . . : 93.184.0.', CAST(user_id % 3 AS STRING), chr(10), '    ----------', chr(10))"""
_DUMP_SPARK = _DUMP.format(agg=f"array_join(transform(array_sort(collect_list(struct(event_id, {_ENTRY} AS e))), x -> x.e), '')")
_DUMP_DUCK = _DUMP.format(agg=f"string_agg({_ENTRY}, '' ORDER BY event_id)").format(events="events")


@query("src_dns_dump", f"""WITH d AS ({_DUMP_DUCK}),
  l AS (SELECT dump_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
  k AS (SELECT *, trim(line) AS t FROM l),
  n AS (SELECT *, last_value(CASE WHEN starts_with(t, 'Record Name') THEN lower(rtrim(trim(regexp_extract(t, ':(.*)$', 1)), '.')) END IGNORE NULLS)
     OVER (PARTITION BY dump_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS domain, trim(regexp_extract(t, ':(.*)$', 1)) AS val FROM k),
  ips AS (SELECT dump_id, host, domain, val, min(pos) AS pos FROM n WHERE contains(t, 'Record . . . : 9') AND val <> '' GROUP BY ALL),
  ip2 AS (SELECT dump_id, host, domain, string_agg(val, ',' ORDER BY pos) AS ips FROM ips GROUP BY ALL),
  tt AS (SELECT dump_id, host, domain, string_agg(CAST(TRY_CAST(val AS INT) AS VARCHAR), ',' ORDER BY pos) AS ttls FROM n
     WHERE starts_with(t, 'Time To Live') AND TRY_CAST(val AS INT) IS NOT NULL GROUP BY ALL)
  SELECT ip2.dump_id, ip2.host, ip2.domain, ips, coalesce(ttls, '') AS ttls FROM ip2 LEFT JOIN tt USING (dump_id, host, domain)""")
def src_dns_dump(spark, sf):
    from threatlake.sources.dumps import parse_dns_dumps

    dumps = spark.sql(_DUMP_SPARK.format(events="{events}"), **tables(spark, sf, "events"))
    return parse_dns_dumps(dumps, ["dump_id", "host"]).select(
        "dump_id", "host", "domain", F.array_join("ips", ",").alias("ips"),
        F.array_join(F.transform("ttls", lambda t: t.cast("string")), ",").alias("ttls"))


@query("src_task_csv", """SELECT concat('T', CAST(event_id AS VARCHAR)) AS task_name, CASE WHEN event_id % 2 = 0 THEN 'Ready' ELSE 'Disabled' END AS status,
  concat('run ', event_type) AS task_to_run, concat('u', CAST(user_id AS VARCHAR)) AS run_as_user FROM events""")
def src_task_csv(spark, sf):
    """Exports with both spellings of the headers, written as CSV and read back."""
    from uuid import uuid4

    from threatlake.session import ensure_checkpoint_dir
    from threatlake.sources.tasks import read_task_exports

    raw = tables(spark, sf, "events")["events"].select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" T"), F.col("event_id").cast("string"))).alias("TaskName"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("T"), F.col("event_id").cast("string"), F.lit(" "))).alias("Task Name"),
        F.concat(F.lit("run "), F.col("event_type"), F.lit(" ")).alias("Task To Run"),
        F.when(F.col("event_id") % 2 == 0, F.lit("Ready")).alias("Status"),
        F.when(F.col("event_id") % 2 == 1, F.lit("Disabled")).alias("Scheduled Task State"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("Run As User"),
    )
    path = f"{ensure_checkpoint_dir(spark)}/tasks-{uuid4().hex}"
    raw.write.option("header", True).csv(path)
    return read_task_exports(spark, path).select("task_name", "status", "task_to_run", "run_as_user")


_ZONE = """SELECT event_id AS file_id, concat('[ZoneTransfer]', chr(13), chr(10), CASE event_id % 4 WHEN 0 THEN 'ZoneId=3' WHEN 1 THEN '  ZoneId=x' WHEN 2 THEN 'Zone=3' ELSE 'ZoneId=0' END, chr(13), chr(10),
  'ReferrerUrl=https://ref.example/', CAST(user_id AS STRING), chr(10), CASE WHEN event_id % 3 = 0 THEN concat('HostUrl= https://dl.example/', CAST(event_id AS STRING)) ELSE '' END) AS content FROM {events}"""


@query("src_zone_marks", f"""WITH z AS ({_ZONE.format(events='events')})
  SELECT file_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(content, 'ZoneId=([0-9]+)', 1), '') AS BIGINT), -1) AS BIGINT) AS zone_id,
    regexp_extract(content, 'HostUrl=[ ]*(.*)', 1) AS host_url, regexp_extract(content, 'ReferrerUrl=(.*)', 1) AS referrer_url,
    regexp_matches(content, 'ZoneId=[0-9]+') AS has_motw FROM z""")
def src_zone_marks(spark, sf):
    from threatlake.sources.zones import parse_zone_marks

    z = parse_zone_marks(spark.sql(_ZONE, **tables(spark, sf, "events")))
    return z.select("file_id", F.coalesce("zone_id", F.lit(-1)).cast("bigint").alias("zone_id"),
                    blank("host_url").alias("host_url"), blank("referrer_url").alias("referrer_url"), "has_motw")


@query("src_feeds", f"""WITH {O.TELE}, f AS (SELECT * FROM (VALUES {', '.join(f"('hash', {O.q(k)})" for k in V.BLOCKLIST_HASHES)}, {', '.join(f"('ip', {O.q(k)})" for k in V.BLOCKLIST_IPS)}, {', '.join(f"('domain', {O.q(k)})" for k in V.BLOCKLIST_DOMAINS)}) AS v(feed, indicator)),
  seen AS (SELECT 'hash' AS feed, lower(sha256) AS indicator FROM tele UNION ALL SELECT 'ip', remote_ip FROM tele UNION ALL SELECT 'domain', {O.CLEAN} FROM tele)
  SELECT f.feed, f.indicator, count(seen.indicator) AS sightings FROM f LEFT JOIN seen ON f.feed = seen.feed AND f.indicator = seen.indicator GROUP BY ALL""")
def src_feeds(spark, sf):
    """Feed entries with the number of telemetry sightings."""
    ev, feeds = telemetry(spark, sf), load_feeds(spark)
    seen = ev.select(F.explode(F.array(
        F.struct(F.lit("hash").alias("feed"), reputation.normal_hash(F.col("sha256")).alias("indicator")),
        F.struct(F.lit("ip").alias("feed"), reputation.normal_ip(F.col("remote_ip")).alias("indicator")),
        F.struct(F.lit("domain").alias("feed"), reputation.normal_domain(F.col("domain")).alias("indicator")),
    )).alias("s")).select("s.*").groupBy("feed", "indicator").agg(F.count(F.lit(1)).alias("n"))
    entries = (
        feeds.hashes.select(F.lit("hash").alias("feed"), "indicator")
        .unionByName(feeds.ips.select(F.lit("ip").alias("feed"), "indicator"))
        .unionByName(feeds.domains.select(F.lit("domain").alias("feed"), "indicator"))
    )
    return entries.join(seen, ["feed", "indicator"], "left").select(
        "feed", "indicator", F.coalesce("n", F.lit(0)).cast("bigint").alias("sightings"))


# --- scalar features -----------------------------------------------------------------------------------


@query("domain_entropy_dga", f"""WITH {O.TELE} SELECT seq, {O.CLEAN} AS domain, {O.ENTROPY} AS entropy, {O.DYNAMIC} AS is_dynamic_dns, {O.ABUSED} AS is_suspicious_tld, {O.DGA} AS is_potential_dga FROM tele WHERE event_type = 'dns_query_observed'""")
def domain_entropy_dga(spark, sf):
    ev = telemetry(spark, sf).where(F.col("event_type") == DNS_TYPE)
    return dns.dns_domain_features(ev).select("seq", "domain", "entropy", "is_dynamic_dns", "is_suspicious_tld", "is_potential_dga")


@query("ip_class", f"""WITH {O.TELE} SELECT seq, remote_ip, {O.PUBLIC} AS is_public_ip FROM tele""")
def ip_class(spark, sf):
    return network.with_ip_class(telemetry(spark, sf)).select("seq", "remote_ip", "is_public_ip")


@query("hosting_provider", f"""WITH {O.TELE} SELECT seq, coalesce(CASE {' '.join(f"WHEN {O.matches(chr(99) + 'oncat(org, chr(32), asn)', p)} THEN {O.q(d)}" for p, d in V.HOSTING_PATTERNS)} END, '') AS hosting_provider FROM tele""")
def hosting_provider(spark, sf):
    return network.with_hosting(telemetry(spark, sf)).select("seq", blank("hosting_provider").alias("hosting_provider"))


@query("writable_path", f"""WITH {O.TELE} SELECT seq, executable, regexp_matches(lower(executable), {O.q(O.WRITABLE_PART)}) AS writable FROM tele""")
def writable_path(spark, sf):
    return telemetry(spark, sf).select("seq", "executable", common.is_writable_path(F.col("executable")).alias("writable"))


@query("part_intersect", f"""WITH {O.TELE} SELECT seq, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(replace(executable, chr(92), '/')), '/'), lambda x: list_contains(['downloads','temp','tmp','appdata','roaming','local'], x)))), ',') AS parts FROM tele""")
def part_intersect(spark, sf):
    from threatlake.functions.text import text_array, windows_parts

    parts = F.array_intersect(windows_parts(F.lower("executable")), text_array(V.WRITABLE_DIRS))
    return telemetry(spark, sf).select("seq", F.array_join(F.array_sort(parts), ",").alias("parts"))


@query("size_fmt", """SELECT doc_id, CASE WHEN n < 1024 THEN concat(CAST(n AS VARCHAR), ' B') WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END AS size
  FROM (SELECT doc_id, n_chars * (1 + doc_id % 5 * doc_id) AS n FROM documents)""")
def size_fmt(spark, sf):
    d = tables(spark, sf, "documents")["documents"]
    return d.select("doc_id", size_label(F.col("n_chars") * (1 + F.col("doc_id") % 5 * F.col("doc_id"))).alias("size"))


@query("double_extension", f"""WITH {O.TELE} SELECT seq, filename, {O.matches('filename', V.DOUBLE_EXTENSION)} AS flagged FROM tele""")
def double_extension(spark, sf):
    return telemetry(spark, sf).select("seq", "filename", common.double_extension(F.col("filename")).alias("flagged"))


@query("masquerading", f"""WITH {O.TELE} SELECT seq, process_name, executable, (lower(process_name) IN {O.names(V.CORE_PROCESSES)} AND executable <> '' AND {O.DIR} NOT IN {O.SYSTEM}) AS flagged FROM tele""")
def masquerading(spark, sf):
    return telemetry(spark, sf).select(
        "seq", "process_name", "executable", common.masquerading(F.col("process_name"), F.col("executable")).alias("flagged"))


@query("suspicious_client", f"""WITH {O.TELE} SELECT seq, process_name, {O.CLIENT} AS flagged FROM tele""")
def suspicious_client(spark, sf):
    return telemetry(spark, sf).select("seq", "process_name", network.is_suspicious_client(F.col("process_name")).alias("flagged"))


# --- reputation -----------------------------------------------------------------------------------------


def _rep(kind: str, column: str, table: dict, clean: str):
    cases = " ".join(f"WHEN {clean} = {O.q(k)} THEN {O.q(v)}" for k, v in table.items())

    @query(f"rep_{kind}", f"""WITH {O.TELE} SELECT seq, CASE WHEN {clean} IN {O.names(table)} THEN 'malicious' ELSE 'unknown' END AS status, coalesce(CASE {cases} END, '') AS threat FROM tele""")
    def run(spark, sf):
        feeds = load_feeds(spark)
        feed = {"hash": feeds.hashes, "ip": feeds.ips, "domain": feeds.domains}[kind]
        out = reputation.with_reputation(telemetry(spark, sf), feed, column, kind)
        return out.select("seq", F.col(f"{kind}_status").alias("status"), blank(f"{kind}_threat").alias("threat"))


_rep("hash", "sha256", V.BLOCKLIST_HASHES, "lower(sha256)")
_rep("ip", "remote_ip", V.BLOCKLIST_IPS, "remote_ip")
_rep("domain", "domain", V.BLOCKLIST_DOMAINS, O.CLEAN)


@query("rep_publisher", f"""WITH {O.TELE} SELECT seq, signer, {O.TRUSTED} AS trusted FROM tele""")
def rep_publisher(spark, sf):
    out = reputation.with_publisher(telemetry(spark, sf), load_feeds(spark).publishers, F.col("signature.signer"))
    return out.select("seq", F.col("signature.signer").alias("signer"), F.col("trusted_publisher").alias("trusted"))


# --- rule families ----------------------------------------------------------------------------------------

from threatlake.operators.rules import network as _rn, persistence as _rp, process as _rpr  # noqa: E402

_TERM = "CASE WHEN event_type = {t} THEN [{r}] ELSE {e} END"


def _ended(t: str, r: str, pair: tuple[str, str]) -> tuple[str, str]:
    return (_TERM.format(t=O.q(t), r=O.q(r), e=pair[0]), _TERM.format(t=O.q(t), r="'info'", e=pair[1]))


query("rules_process", O.family(_ended("process_terminated", "PROC_TERMINATED", O.PROCESS), "event_type LIKE 'process_%'"))(
    family(_rpr.process_findings, "process_started", "process_observed", "process_terminated"))
query("rules_persistence", O.family(_ended("startup_item_removed", "PERSIST_REMOVED", O.AUTORUN), "event_type LIKE 'startup_item_%'"))(
    family(_rp.persistence_findings, "startup_item_added", "startup_item_modified", "startup_item_removed"))
query("rules_task", O.family(O.TASK, "event_type LIKE 'scheduled_task_%'"))(family(_rp.task_findings, "scheduled_task_created"))
query("rules_service", O.family(O.SERVICE, "event_type LIKE 'service_%'"))(family(_rp.service_findings, "service_installed"))
query("rules_network", O.family(O.NETWORK, "event_type = 'network_connection_observed'"))(family(_rn.network_findings, NETWORK_TYPE))
query("rules_dns", O.family(O.DNS, "event_type = 'dns_query_observed'"))(family(_rn.dns_findings, DNS_TYPE))
query("rules_download", O.family(O.DOWNLOAD, "event_type = 'file_download_observed'"))(family(_rn.download_findings, DOWNLOAD_TYPE))
query("corr_proc_net", O.family(O.CORR, "event_type = 'network_connection_observed'"))(family(_rn.corr_proc_net, NETWORK_TYPE))


@query("rules_generic", O.ALL + " SELECT seq, event_type, array_to_string(ids, ',') AS rules FROM scored WHERE event_type = 'usb_inserted'")
def rules_generic(spark, sf):
    return judged(spark, sf, "usb_inserted").select("seq", "event_type", rule_ids(RULES).alias("rules"))


@query("evaluate_events", O.ALL + " SELECT seq, event_type, process_name AS target, array_to_string(ids, ',') AS rules, score, severity, score >= 35 AS has_threats FROM scored")
def evaluate_events(spark, sf):
    return as_long(judged(spark, sf).select("seq", "event_type", "target", rule_ids(RULES).alias("rules"), "score", "severity", "has_threats"))


@query("union_findings", O.ALL + " SELECT seq, unnest(ids) AS rule_id FROM scored WHERE event_type = 'network_connection_observed'")
def union_findings(spark, sf):
    return judged(spark, sf, NETWORK_TYPE).select("seq", F.explode(RULES).alias("f")).select("seq", "f.rule_id")


@query("score_findings", O.ALL + ", l AS (SELECT seq, unnest(sevs) AS sev FROM scored) SELECT seq, count(*) AS findings, CAST(min(s.score) AS BIGINT) AS score FROM l JOIN scored s USING (seq) GROUP BY seq")
def score_findings(spark, sf):
    """Grouped form over exploded findings."""
    long = judged(spark, sf).select("seq", F.explode(RULES).alias("f")).select("seq", "f.severity")
    return as_long(score_findings_agg(long, ["seq"]).select("seq", F.col("finding_count").alias("findings"), "score"))


@query("severity_counts", O.ALL + """ SELECT seq, CAST(len(list_filter(sevs, lambda x: x = 'critical')) AS BIGINT) AS critical, CAST(len(list_filter(sevs, lambda x: x = 'high')) AS BIGINT) AS high,
  CAST(len(list_filter(sevs, lambda x: x = 'medium')) AS BIGINT) AS medium, CAST(len(list_filter(sevs, lambda x: x = 'low')) AS BIGINT) AS low, CAST(len(list_filter(sevs, lambda x: x = 'info')) AS BIGINT) AS info FROM scored""")
def severity_counts(spark, sf):
    counts = F.col("assessment.severity_counts")
    return as_long(judged(spark, sf).select("seq", *[counts[s].alias(s) for s in ("critical", "high", "medium", "low", "info")]))


@query("rule_prevalence", O.ALL + """, l AS (SELECT host, seq, unnest(ids) AS rule_id, unnest(sevs) AS sev FROM scored)
  SELECT coalesce(rule_id, 'ALL') AS rule_id, coalesce(sev, 'ALL') AS severity, coalesce(host, 'ALL') AS host, count(*) AS findings FROM l GROUP BY ROLLUP (rule_id, sev, host)""")
def rule_prevalence(spark, sf):
    long = judged(spark, sf).select("host", F.explode(RULES).alias("f")).select("host", "f.rule_id", "f.severity")
    return long.rollup("rule_id", "severity", "host").agg(F.count(F.lit(1)).alias("findings")).select(
        F.coalesce("rule_id", F.lit("ALL")).alias("rule_id"), F.coalesce("severity", F.lit("ALL")).alias("severity"),
        F.coalesce("host", F.lit("ALL")).alias("host"), "findings")


# --- decisions ---------------------------------------------------------------------------------------------

_ALARM = "(score >= 70 OR list_contains(sevs, 'critical') OR len(list_filter(ids, lambda r: contains(r, 'BLOCKLIST'))) > 0)"
_SYSFILE = "regexp_matches(lower(file_path), '[\\\\/](system32|syswow64)[\\\\/]')"


@query("prevention_decision", O.ALL + f""" SELECT seq, {_ALARM} AS justified,
  array_to_string(list_filter([CASE WHEN {_ALARM} AND lower(process_name) NOT IN {O.names(V.PROTECTED_PROCESSES)} THEN 'terminate_process' END, CASE WHEN {_ALARM} AND NOT {_SYSFILE} THEN 'quarantine_file' END], lambda x: x IS NOT NULL), ',') AS planned_actions,
  array_to_string(list_filter([CASE WHEN {_ALARM} AND lower(process_name) IN {O.names(V.PROTECTED_PROCESSES)} THEN 'protected-process' END, CASE WHEN {_ALARM} AND {_SYSFILE} THEN 'system-file' END], lambda x: x IS NOT NULL), ',') AS refusals FROM scored""")
def prevention_decision(spark, sf):
    return decisions.plan_prevention(judged(spark, sf)).select("seq", "justified", "planned_actions", "refusals")


@query("download_decision", O.ALL + f""" SELECT seq, CASE WHEN score >= 50 THEN 'HIGH_RISK' ELSE 'LOW_RISK' END AS decision,
  CASE WHEN score < 50 THEN 'ALLOW_NORMAL_ACTIVITY' WHEN {_ALARM} AND (lower(process_name) NOT IN {O.names(V.PROTECTED_PROCESSES)} OR NOT {_SYSFILE}) THEN 'ALERT_AND_PREVENTION_APPLIED' ELSE 'GENERATE_ALERT' END AS action,
  CAST(len(ids) AS BIGINT) AS evidence_count FROM scored WHERE event_type = 'file_download_observed'""")
def download_decision(spark, sf):
    out = decisions.decide_downloads(decisions.plan_prevention(judged(spark, sf, DOWNLOAD_TYPE)))
    return as_long(out.select("seq", "decision", "action", "evidence_count"))


# --- snapshots ----------------------------------------------------------------------------------------------


def _two_days(spark, sf, types, keys, fields):
    """Latest row per key of the even days (previous) and of the odd days (current)."""
    ev = telemetry(spark, sf).where(F.col("event_type").isin(*types))
    day = F.day("ts") % 2
    side = lambda n: ev.where(day == n).groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct("ts", "seq")).alias("v")).select(*keys, "v.*")
    return side(0), side(1)


def _sides(types: str, keys: str, fields: dict[str, str]) -> str:
    picks = ", ".join(f"arg_max({e}, struct_pack(a := ts, b := seq)) AS {n}" for n, e in fields.items())
    side = lambda n: f"SELECT {keys}, {picks} FROM tele WHERE event_type IN {types} AND day(ts) % 2 = {n} GROUP BY {keys}"
    return f"WITH {O.TELE}, p AS ({side(0)}), c AS ({side(1)})"


@query("diff_processes", _sides("('process_started')", "host, pid", {"process_name": "process_name", "create_time": "CAST(seq AS DOUBLE)"}) + """,
  b AS (SELECT coalesce(c.host, p.host) AS host, coalesce(c.pid, p.pid) AS pid, c.process_name AS cn, p.process_name AS pn, c.create_time AS ct, p.create_time AS pt FROM c FULL JOIN p ON c.host = p.host AND c.pid = p.pid)
  SELECT host, pid, 'process_started' AS event_type, cn AS process_name FROM b WHERE ct IS NOT NULL AND (pt IS NULL OR ct <> pt)
  UNION ALL SELECT host, pid, 'process_terminated', pn FROM b WHERE pt IS NOT NULL AND (ct IS NULL OR ct <> pt)""")
def diff_processes(spark, sf):
    ev = telemetry(spark, sf).where(F.col("event_type") == "process_started").withColumn("create_time", F.col("seq").cast("double"))
    side = lambda n: ev.where(F.day("ts") % 2 == n).groupBy("host", "pid").agg(
        F.max_by(F.struct("process_name", "create_time"), F.struct("ts", "seq")).alias("v")).select("host", "pid", "v.*")
    return snapshots.diff_processes(side(0), side(1)).select("host", "pid", "event_type", "process_name")


def _diff_sql(types, keys, compare, labels, shown):
    on = " AND ".join(f"c.{k} = p.{k}" for k in keys)
    changed = " OR ".join(f"c.{x} IS DISTINCT FROM p.{x}" for x in compare)
    picks = {x: ("command" if x not in ("run_as_user", "start_type") else "CAST(zone_id AS VARCHAR)") for x in shown}
    head = _sides(types, "host, name", picks)
    return head + f""", b AS (SELECT coalesce(c.host, p.host) AS host, coalesce(c.name, p.name) AS name,
      CASE WHEN p.host IS NULL THEN '{labels[0]}' WHEN c.host IS NULL THEN '{labels[2]}' WHEN {changed} THEN '{labels[1]}' END AS event_type,
      coalesce(CASE WHEN p.host IS NOT NULL AND c.host IS NOT NULL THEN p.{shown[0]} END, '') AS previous FROM c FULL JOIN p ON {on})
      SELECT * FROM b WHERE event_type IS NOT NULL"""


_ADDED = "('startup_item_added', 'scheduled_task_created', 'service_installed')"


@query("diff_startup", _diff_sql("('startup_item_added')", ["host", "name"], ["command"], ("startup_item_added", "startup_item_modified", "startup_item_removed"), ["command"]))
def diff_startup(spark, sf):
    p, c = _two_days(spark, sf, ["startup_item_added"], ["host", "name"], ["command"])
    item = lambda d: d.withColumnRenamed("name", "item_id")
    return snapshots.diff_startup(item(p), item(c)).select("host", F.col("item_id").alias("name"), "event_type", blank("previous_command").alias("previous"))


@query("diff_tasks", _diff_sql("('scheduled_task_created')", ["host", "name"], ["task_to_run", "run_as_user"], ("scheduled_task_created", "scheduled_task_modified", "scheduled_task_deleted"), ["task_to_run", "run_as_user"]))
def diff_tasks(spark, sf):
    ev = ["task_to_run", F.col("zone_id").cast("string").alias("run_as_user")]
    p, c = _two_days(spark, sf, ["scheduled_task_created"], ["host", "task_name"], ev)
    return snapshots.diff_tasks(p, c).select("host", F.col("task_name").alias("name"), "event_type", blank("previous_task_to_run").alias("previous"))


@query("diff_services", _diff_sql("('service_installed')", ["host", "name"], ["binpath", "start_type"], ("service_installed", "service_modified", "service_removed"), ["binpath", "start_type"]))
def diff_services(spark, sf):
    ev = ["binpath", F.col("zone_id").cast("string").alias("start_type"), F.lit("running").alias("status")]
    p, c = _two_days(spark, sf, ["service_installed"], ["host", "name"], ev)
    return snapshots.diff_services(p, c).select("host", "name", "event_type", blank("previous_binpath").alias("previous"))


@query("new_connections", f"""WITH {O.TELE}, n AS (SELECT * FROM tele WHERE event_type = 'network_connection_observed'),
  p AS (SELECT DISTINCT host, pid, remote_ip, remote_port FROM n WHERE day(ts) <= 15), c AS (SELECT host, pid, remote_ip, remote_port, arg_max(seq, struct_pack(a := ts, b := seq)) AS seq FROM n WHERE day(ts) > 15 GROUP BY ALL)
  SELECT c.* FROM c ANTI JOIN p ON c.host = p.host AND c.pid = p.pid AND c.remote_ip = p.remote_ip AND c.remote_port = p.remote_port""")
def new_connections(spark, sf):
    ev = telemetry(spark, sf).where(F.col("event_type") == NETWORK_TYPE)
    out = snapshots.new_connections(ev.where(F.day("ts") <= 15), ev.where(F.day("ts") > 15))
    return as_long(out.select("host", "pid", "remote_ip", "remote_port", "seq"))


@query("new_dns", f"""WITH {O.TELE}, n AS (SELECT *, {O.CLEAN} AS d FROM tele WHERE event_type = 'dns_query_observed')
  SELECT DISTINCT host, d AS domain FROM n WHERE day(ts) > 3 AND NOT EXISTS (SELECT 1 FROM n m WHERE m.host = n.host AND m.d = n.d AND day(m.ts) <= 3)""")
def new_dns(spark, sf):
    ev = dns.dns_domain_features(telemetry(spark, sf).where(F.col("event_type") == DNS_TYPE)).select("host", "domain", "ts")
    return snapshots.new_dns(ev.where(F.day("ts") <= 3), ev.where(F.day("ts") > 3).select("host", "domain").distinct())


query("key_except", f"""WITH {O.TELE}, n AS (SELECT host, pid, day(ts) AS d FROM tele)
  SELECT host, pid FROM n WHERE d > 15 EXCEPT SELECT host, pid FROM n WHERE d <= 15 AND pid % 2 = 0""")(
    lambda spark, sf: snapshots.new_keys(
        telemetry(spark, sf).where((F.day("ts") <= 15) & (F.col("pid") % 2 == 0)).select("host", "pid"),
        telemetry(spark, sf).where(F.day("ts") > 15).select("host", "pid").distinct(), ["host", "pid"]))


@query("new_downloads", f"""WITH {O.TELE}, n AS (SELECT host, concat('f', CAST(seq % 40 AS VARCHAR)) AS path, CASE WHEN seq % 3 = 0 THEN '.crdownload' ELSE extension END AS ext, ts, seq FROM tele WHERE event_type = 'file_download_observed'),
  p AS (SELECT host, path, arg_max(ext, struct_pack(a := ts, b := seq)) AS ext FROM n WHERE day(ts) <= 15 GROUP BY ALL), c AS (SELECT host, path, arg_max(ext, struct_pack(a := ts, b := seq)) AS ext FROM n WHERE day(ts) > 15 GROUP BY ALL)
  SELECT c.host, c.path, c.ext FROM c LEFT JOIN p ON c.host = p.host AND c.path = p.path WHERE c.ext <> '.crdownload' AND (p.ext IS NULL OR p.ext = '.crdownload')""")
def new_downloads(spark, sf):
    ev = telemetry(spark, sf).where(F.col("event_type") == DOWNLOAD_TYPE).select(
        "host", F.concat(F.lit("f"), (F.col("seq") % 40).cast("string")).alias("path"),
        F.when(F.col("seq") % 3 == 0, ".crdownload").otherwise(F.col("extension")).alias("ext"), "ts", "seq")
    side = lambda d: d.groupBy("host", "path").agg(F.max_by("ext", F.struct("ts", "seq")).alias("ext"))
    return snapshots.diff_downloads(side(ev.where(F.day("ts") <= 15)), side(ev.where(F.day("ts") > 15)))


# --- as-of and containment joins ------------------------------------------------------------------------------

_ASOF = f"""WITH {O.TELE}, d AS (SELECT host, lower(file_path) AS path, lower(sha256) AS h, ts, seq FROM tele WHERE event_type = 'file_download_observed'),
  s AS (SELECT host, pid, lower(executable) AS path, lower(sha256) AS h, ts, seq FROM tele WHERE event_type = 'process_started'),
  a AS (SELECT s.seq, arg_max(d.seq, struct_pack(a := d.ts, b := d.seq)) AS dl FROM s JOIN d ON s.host = d.host AND s.path = d.path AND s.path <> '' AND (d.ts < s.ts OR (d.ts = s.ts AND d.seq < s.seq)) GROUP BY s.seq),
  b AS (SELECT s.seq, arg_max(d.seq, struct_pack(a := d.ts, b := d.seq)) AS dl FROM s JOIN d ON s.host = d.host AND s.h = d.h AND s.h <> '' AND (d.ts < s.ts OR (d.ts = s.ts AND d.seq < s.seq)) GROUP BY s.seq),
  x AS (SELECT s.seq, s.host, s.pid, s.ts, coalesce(a.dl, b.dl) AS download_seq FROM s LEFT JOIN a ON a.seq = s.seq LEFT JOIN b ON b.seq = s.seq)"""


@query("asof_download_process", _ASOF + " SELECT seq, download_seq FROM x WHERE download_seq IS NOT NULL")
def asof_download_process(spark, sf):
    return correlate.asof_downloads(telemetry(spark, sf)).where(F.col("download").isNotNull()).select(
        "seq", F.col("download.seq").alias("download_seq"))


_CALLS = """, m AS (SELECT host, pid, ts, seq, download_seq FROM x WHERE download_seq IS NOT NULL UNION ALL SELECT host, pid, ts, seq, NULL FROM tele WHERE event_type = 'process_terminated'),
  n AS (SELECT t.seq, arg_max(struct_pack(d := m.download_seq), struct_pack(a := m.ts, b := m.seq)).d AS download_seq FROM tele t JOIN m ON t.host = m.host AND t.pid = m.pid AND (m.ts < t.ts OR (m.ts = t.ts AND m.seq < t.seq)) WHERE t.event_type = 'network_connection_observed' GROUP BY t.seq)"""


@query("asof_process_network", _ASOF + _CALLS + " SELECT seq, download_seq FROM n WHERE download_seq IS NOT NULL")
def asof_process_network(spark, sf):
    return correlate.asof_process_network(telemetry(spark, sf)).select("seq", F.col("download.seq").alias("download_seq"))


@query("contain_download_persist", f"""WITH {O.TELE}, d AS (SELECT host, lower(file_path) AS path, lower(filename) AS name, ts, seq FROM tele WHERE event_type = 'file_download_observed'),
  e AS (SELECT host, lower(command) AS text, ts, seq FROM tele WHERE event_type IN ('startup_item_added', 'startup_item_removed', 'scheduled_task_created', 'service_installed'))
  SELECT e.seq, arg_min(d.seq, struct_pack(a := d.ts, b := d.seq)) AS download_seq FROM e JOIN d ON e.host = d.host AND (contains(e.text, d.path) OR contains(e.text, d.name)) AND (d.ts < e.ts OR (d.ts = e.ts AND d.seq < e.seq)) GROUP BY e.seq""")
def contain_download_persist(spark, sf):
    return correlate.contain_download_persist(telemetry(spark, sf)).select("seq", "download_seq")


@query("owner_enrich", f"""WITH {O.TELE}, s AS (SELECT * FROM tele WHERE event_type = 'process_started'), n AS (SELECT * FROM tele WHERE event_type = 'network_connection_observed')
  SELECT n.seq, arg_max(s.process_name, struct_pack(a := s.ts, b := s.seq)) AS process_name, arg_max(s.executable, struct_pack(a := s.ts, b := s.seq)) AS executable
  FROM n JOIN s ON n.host = s.host AND n.pid = s.pid AND (s.ts < n.ts OR (s.ts = n.ts AND s.seq < n.seq)) GROUP BY n.seq""")
def owner_enrich(spark, sf):
    ev = telemetry(spark, sf)
    net = ev.where(F.col("event_type") == NETWORK_TYPE)
    return correlate.with_owner(net, ev.where(F.col("event_type") == "process_started")).select("seq", "process_name", "executable")


@query("parent_name", f"""WITH {O.TELE}, s AS (SELECT host, CAST(ts AS DATE) AS d, pid, arg_max(process_name, struct_pack(a := ts, b := seq)) AS process_name, arg_max(1000 + seq % 40, struct_pack(a := ts, b := seq)) AS ppid FROM tele WHERE event_type = 'process_started' GROUP BY ALL)
  SELECT s.host, epoch_us(CAST(s.d AS TIMESTAMP)) AS day_us, s.pid, s.process_name, coalesce(p.process_name, '') AS parent_name FROM s LEFT JOIN s p ON s.host = p.host AND s.d = p.d AND s.ppid = p.pid""")
def parent_name(spark, sf):
    ev = telemetry(spark, sf).where(F.col("event_type") == "process_started")
    snap = ev.groupBy("host", F.date_trunc("day", "ts").alias("snapshot_ts"), "pid").agg(
        F.max_by(F.struct("process_name", (F.lit(1000) + F.col("seq") % 40).alias("parent_pid")), F.struct("ts", "seq")).alias("v")
    ).select("host", "snapshot_ts", "pid", "v.*")
    return correlate.with_parent(snap).select("host", F.unix_micros("snapshot_ts").alias("day_us"), "pid", "process_name", blank("parent_name").alias("parent_name"))


# --- trackers -------------------------------------------------------------------------------------------------


@query("pid_generation", f"WITH {O.TELE}, {O.GEN} SELECT seq, host, pid, generation FROM lives")
def pid_generation(spark, sf):
    return as_long(network.with_generation(telemetry(spark, sf)).select("seq", "host", "pid", "generation"))


@query("conn_burst", f"WITH {O.TELE}, {O.GEN}, {O.STATS} SELECT seq, connection_count, connection_count >= 5 AS is_repeated_burst FROM net")
def conn_burst(spark, sf):
    return as_long(network.with_connection_stats(telemetry(spark, sf)).select("seq", "connection_count", "is_repeated_burst"))


@query("conn_fanout", f"WITH {O.TELE}, {O.GEN}, {O.STATS} SELECT seq, unique_destinations, unique_destinations >= 8 AS is_wide_fanout FROM net")
def conn_fanout(spark, sf):
    return as_long(network.with_connection_stats(telemetry(spark, sf)).select("seq", "unique_destinations", "is_wide_fanout"))


@query("active_processes", f"""WITH {O.TELE}, l AS (SELECT host, pid, arg_max(struct_pack(t := event_type, n := process_name, s := seq), struct_pack(a := ts, b := seq)) AS p FROM tele WHERE event_type IN ('process_started', 'process_terminated') GROUP BY ALL)
  SELECT host, pid, concat(CAST(pid AS VARCHAR), '_0') AS identity, p.n AS process_name, p.s AS seq FROM l WHERE p.t <> 'process_terminated'""")
def active_processes(spark, sf):
    return network.active_processes(telemetry(spark, sf)).select("host", "pid", "identity", "process_name", "seq")


_FP_FINDING = "sha256(concat(event_type, '|', CAST(pid AS VARCHAR), '|', process_name, '|', rule_id, '|', remote_ip, '|', CAST(remote_port AS VARCHAR), '|', coalesce(CASE WHEN event_type LIKE 'startup_item%' THEN command WHEN event_type LIKE 'scheduled_task%' THEN name END, '')))"
_LONG = f", long AS (SELECT seq, host, ts, event_type, pos, {_FP_FINDING} AS fingerprint FROM (SELECT *, unnest(ids) AS rule_id, unnest(range(len(ids))) AS pos FROM scored))"


@query("finding_fingerprint", O.ALL + _LONG + " SELECT seq, pos, fingerprint FROM long")
def finding_fingerprint(spark, sf):
    long = judged(spark, sf).select("*", F.posexplode(RULES).alias("pos", "f"))
    return as_long(long.select("seq", "pos", dedup.finding_fingerprint(F.col("f.rule_id")).alias("fingerprint")))


@query("event_fingerprint", O.ALL + f" SELECT seq, {O.FINGERPRINT_EVENT} AS fingerprint FROM scored")
def event_fingerprint(spark, sf):
    return judged(spark, sf).select("seq", dedup.event_fingerprint(F.transform(RULES, lambda f: f["rule_id"])).alias("fingerprint"))


_DAY = 86400
_RECURSE = f""", o AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY host, fingerprint ORDER BY ts, seq, pos) AS rn FROM long WHERE NOT regexp_matches(event_type, '^(startup_item|scheduled_task|service)_')),
  r AS (SELECT host, fingerprint, rn, t AS last_t, true AS emitted, seq, pos FROM o WHERE rn = 1
    UNION ALL SELECT o.host, o.fingerprint, o.rn, CASE WHEN o.t - r.last_t >= {_DAY}000000 THEN o.t ELSE r.last_t END, o.t - r.last_t >= {_DAY}000000, o.seq, o.pos
    FROM r JOIN o ON o.host = r.host AND o.fingerprint = r.fingerprint AND o.rn = r.rn + 1)"""


@query("dedup_cooldown", O.ALL.replace("WITH ", "WITH RECURSIVE ", 1) + _LONG + _RECURSE + " SELECT seq, CAST(pos AS BIGINT) AS pos, emitted FROM r")
def dedup_cooldown(spark, sf):
    long = (
        judged(spark, sf)
        .where(~F.col("event_type").rlike("^(startup_item|scheduled_task|service)_"))
        .select("*", F.posexplode(RULES).alias("pos", "f"))
        .select("host", "seq", "ts", "pos", dedup.finding_fingerprint(F.col("f.rule_id")).alias("fingerprint"))
    )
    return as_long(dedup.cooldown(cut_lineage(long), ["host", "fingerprint"], ["seq", "pos"], _DAY).select("seq", "pos", "emitted"))


@query("dedup_store", _STORE + f" SELECT {_STORE_COLS} FROM store")
def dedup_store(spark, sf):
    return _store_row(store.to_store(judged(spark, sf), GAP))


@query("first_last_seen", _STORE + " SELECT host, fingerprint, min(first_us) AS first_us, max(last_us) AS last_us, CAST(sum(repeat_count) AS BIGINT) AS repeats FROM store GROUP BY ALL")
def first_last_seen(spark, sf):
    s = store.to_store(judged(spark, sf), GAP)
    return s.groupBy("host", "fingerprint").agg(
        F.unix_micros(F.min("first_seen")).alias("first_us"), F.unix_micros(F.max("last_seen")).alias("last_us"),
        F.sum("repeat_count").alias("repeats"))


# --- store ------------------------------------------------------------------------------------------------------


@query("store_upsert", _STORE + f" SELECT {_STORE_COLS} FROM store")
def store_upsert(spark, sf):
    """Three interleaved thirds of the events, added to the store one after the other; sessions are split over all of them."""
    from uuid import uuid4

    from threatlake.operators import upsert
    from threatlake.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/upsert-{uuid4().hex}"
    events = cut_lineage(judged(spark, sf))
    for version in range(3):
        part = cut_lineage(store.to_store(events.where(F.col("seq") % 3 == version), GAP))
        upsert.upsert(part, path, version, GAP)
    return _store_row(upsert.read_live(spark, path, part.schema))



@query("sink_store", _STORE + " SELECT CAST(CAST(make_timestamp(first_us) AS DATE) AS VARCHAR) AS event_date, count(*) AS events, CAST(sum(repeat_count) AS BIGINT) AS observations FROM store GROUP BY ALL")
def sink_store(spark, sf):
    """Write the store partitioned by date into the shared folder, read it back and count per day."""
    from uuid import uuid4

    from threatlake.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid4().hex}"
    store.write_events(store.to_store(judged(spark, sf), GAP), path)
    back = store.read_store(spark, path)
    return back.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("repeat_count").alias("observations"))


@query("recent_events", _STORE + f" SELECT {_STORE_COLS} FROM store ORDER BY id DESC LIMIT 20")
def recent_events(spark, sf):
    return _store_row(store.recent(store.to_store(judged(spark, sf), GAP), 20))


@query("query_events", _STORE + _OUTBOX + f" SELECT {_STORE_COLS} FROM outbox WHERE score >= 50 AND score <= 90 AND severity = 'high' AND sync_status = 'pending' AND first_us >= epoch_us(TIMESTAMP '2024-01-05') AND first_us <= epoch_us(TIMESTAMP '2024-01-25') ORDER BY id DESC LIMIT 50 OFFSET 10")
def query_events(spark, sf):
    return _store_row(store.query(stored(spark, sf), severity="HIGH", min_score=50, max_score=90, sync_status="pending",
                                  start_time="2024-01-05", end_time="2024-01-25", limit=50, offset=10))


@query("get_event", _STORE + f" SELECT {_STORE_COLS} FROM store WHERE id = 42")
def get_event(spark, sf):
    return _store_row(store.get(store.to_store(judged(spark, sf), GAP), 42))


@query("event_stats", _STORE + _OUTBOX + """ SELECT CASE WHEN GROUPING(severity) = 0 THEN 'severity' WHEN GROUPING(sync_status) = 0 THEN 'sync_status' ELSE 'total' END AS dimension,
  coalesce(severity, sync_status, 'all') AS value, count(*) AS events, max(score) AS max_score, min(first_us) AS oldest_us, max(first_us) AS newest_us FROM outbox GROUP BY GROUPING SETS ((severity), (sync_status), ())""")
def event_stats(spark, sf):
    out = store.event_stats(stored(spark, sf))
    return as_long(out.select("dimension", "value", "events", "max_score", F.unix_micros("oldest").alias("oldest_us"), F.unix_micros("newest").alias("newest_us")))


@query("queue_stats", _STORE + _OUTBOX + " SELECT count(*) FILTER (sync_status = 'pending') AS pending, count(*) FILTER (sync_status = 'synced') AS synced, count(*) FILTER (sync_status = 'failed') AS failed, count(*) FILTER (sync_status = 'failed' AND retry_count >= 5) AS exhausted FROM outbox")
def queue_stats(spark, sf):
    return store.queue_stats(stored(spark, sf))


@query("fetch_pending", _STORE + _OUTBOX + f" SELECT {_STORE_COLS} FROM outbox WHERE sync_status IN ('pending', 'failed') AND retry_count < 5 ORDER BY id LIMIT 50")
def fetch_pending(spark, sf):
    return _store_row(store.pending(stored(spark, sf)))


_TRY = "SELECT CAST(event_id AS BIGINT) AS id, ts AS at, attempt_seq, CASE (event_id + attempt_seq) % 4 WHEN 0 THEN 'synced' WHEN 3 THEN 'reset' ELSE 'failed' END AS outcome, concat('e', CAST(attempt_seq AS STRING)) AS error FROM {events} CROSS JOIN (SELECT 1 AS attempt_seq UNION ALL SELECT 2 UNION ALL SELECT 3) a"


@query("outbox_apply", (_STORE + _OUTBOX).replace("WITH ", "WITH RECURSIVE ", 1) + f""", tries AS ({_TRY.format(events='events')}),
  f AS (SELECT id, 0 AS n, sync_status AS st, CAST(retry_count AS BIGINT) AS rc, '' AS err FROM outbox
    UNION ALL SELECT f.id, t.attempt_seq, CASE WHEN t.outcome <> 'reset' THEN t.outcome WHEN f.st = 'failed' THEN 'pending' ELSE f.st END,
      CASE WHEN t.outcome = 'failed' THEN f.rc + 1 WHEN t.outcome = 'reset' AND f.st = 'failed' THEN 0 ELSE f.rc END,
      CASE WHEN t.outcome = 'failed' THEN t.error WHEN t.outcome = 'synced' OR f.st = 'failed' THEN '' ELSE f.err END FROM f JOIN tries t ON t.id = f.id AND t.attempt_seq = f.n + 1)
  SELECT id, st AS sync_status, rc AS retry_count, err AS error_message FROM f WHERE n = 3""")
def outbox_apply(spark, sf):
    tries = spark.sql(_TRY.replace("STRING", "STRING"), **tables(spark, sf, "events")).withColumn("at", F.col("at").cast("timestamp"))
    out = store.apply_sync(cut_lineage(stored(spark, sf)), tries)
    return as_long(out.select("id", "sync_status", "retry_count", blank("error_message").alias("error_message")))


@query("retention_age", _STORE + f" SELECT {_STORE_COLS} FROM store WHERE first_us >= epoch_us(TIMESTAMP '2024-01-21') OR severity IN ('high', 'critical')")
def retention_age(spark, sf):
    return _store_row(store.expire(store.to_store(judged(spark, sf), GAP), "2024-01-31", days=10))


@query("retain", _STORE + """, fresh AS (SELECT * FROM store WHERE first_us >= epoch_us(TIMESTAMP '2024-01-21') OR severity IN ('high', 'critical')),
  low AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN severity IN ('high', 'critical') THEN 1 ELSE 0 END, id) AS rn, (SELECT count(*) FROM fresh) AS n FROM fresh)
  SELECT id FROM low WHERE rn > n - 2000 OR n <= 2000""")
def retain(spark, sf):
    """Age, then capacity, as a job on the store."""
    rows = cut_lineage(store.to_store(judged(spark, sf), GAP).select("id", "severity", "timestamp"))
    return store.retain(rows, "2024-01-31", days=10, max_rows=2000)[0].select("id")


@query("retention_capacity", _STORE + """, low AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN severity IN ('high', 'critical') THEN 1 ELSE 0 END, id) AS rn, (SELECT count(*) FROM store) AS n FROM store)
  SELECT id FROM low WHERE rn > n - 3000 OR n <= 3000""")
def retention_capacity(spark, sf):
    return store.cap(cut_lineage(store.to_store(judged(spark, sf), GAP).select("id", "severity")), 3000)[0].select("id")

"""Registered queries of e-mail, intelligence, models, detectors and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatlake import fixed_values_phishing as P
from threatlake.catalog import endpoint as E, fixtures as X, phishing_oracle as O
from threatlake.catalog.endpoint_oracle import names, q
from threatlake.catalog.registry import Catalog, as_long
from threatlake.functions.findings import RULES
from threatlake.functions.signals import signal_ids, with_verdict
from threatlake.functions.text import blank
from threatlake.operators import dedup, emails as M, headers as H, intel as I, ml, registry as R, urls as U
from threatlake.operators.domains import with_registrable
from threatlake.session import cut_lineage, put_down
from threatlake.sources import mail as S

catalog = Catalog()
query = catalog.query

ADDR = f"addr AS ({X.ADDRESSES.format(documents='documents')})"
_OK_DOM = "regexp_matches(dom, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+[a-z0-9-]*[a-z][a-z0-9-]*$')"
_VALID = f"({_OK_DOM} AND NOT contains(loc, '..'))"
_REG = O.reg("dom")
_FREE = f"({_REG} IN {names(P.FREE_PROVIDERS)})"
_TYPO = "(" + " OR ".join(f"damerau_levenshtein({_REG}, {q(t)}) = 1" for t in P.FREEMAIL_TYPO_TARGETS) + ")"
_DIG = lambda c: f"len(regexp_replace({c}, '[^0-9]', '', 'g'))"
DOMAIN_RULES = [
    (f"{_REG} IN {names(P.DISPOSABLE_DOMAINS)}", "disposable-domain", 45),
    (f"NOT {_FREE} AND {_TYPO}", "freemail-typo", 45),
    (f"NOT {_FREE} AND regexp_extract(dom, '([^.]*)$', 1) IN {names(P.EMAIL_TLDS)}", "suspicious-tld", 20),
    (f"len(string_split(dom, '.')) - len(string_split({_REG}, '.')) >= 3", "deep-subdomain", 15),
    (f"len(dom) > 8 AND {_DIG('dom')}::DOUBLE / len(dom) > 0.3", "digit-heavy-domain", 15),
    ("dom = 'examplee.com'", "resembles-this-site", 40),
    ("dom = 'example-secure.com'", "contains-this-site-name", 35),
]
LOCAL_RULES = [
    (f"loc IN ('support', 'paypal.support') AND {_FREE}", "authority-on-freemail", 35),
    ("loc IN ('paypal.support', 'sbi')", "brand-in-local-part", 45),
    (f"{_DIG('loc')} >= 6 OR (len(loc) >= 8 AND {_DIG('loc')}::DOUBLE / len(loc) > 0.4)", "random-local-part", 15),
    ("len(loc) >= 40", "very-long-local-part", 10),
]
DISPLAY_RULES = [
    (f"display_name = 'support@paypal.com' AND {_REG} <> 'paypal.com'", "display-name-email-mismatch", 55),
    (f"display_name = 'PayPal Support' AND {_REG} <> 'paypal.com'", "display-name-impersonation", 50),
    (f"display_name = 'State Bank of India' AND {_REG} NOT IN ('sbi.co.in', 'onlinesbi.sbi', 'sbicard.com')", "display-name-impersonation", 50),
]


def _lists(rules, guard: str) -> tuple[str, str]:
    ids = ", ".join(f"CASE WHEN {guard} AND ({c}) THEN {q(i)} END" for c, i, _ in rules)
    ws = ", ".join(f"CASE WHEN {guard} AND ({c}) THEN {w} END" for c, _, w in rules)
    return f"list_filter([{ids}], {O.NOT_NULL})", f"list_filter([{ws}], {O.NOT_NULL})"


def _only(rules) -> str:
    return f"WITH {ADDR} SELECT doc_id, array_to_string({_lists(rules, 'true')[0]}, ',') AS signals FROM addr WHERE {_VALID}"


def _valid_addresses(spark, sf):
    return with_registrable(M.validate_emails(X.addresses(spark, sf)).where("valid"), "domain")


_PLAIN = "regexp_extract_all(text, '[^\\s<>()\\[\\]{}\"'',;]+@[^\\s<>()\\[\\]{}\"'',;]+', 0)"


@query("email_extract", f"""WITH t AS ({X.EMAIL_TEXT.format(documents='documents')}), a AS (SELECT doc_id, unnest({_PLAIN}) AS raw, generate_subscripts({_PLAIN}, 1) AS pos FROM t),
  c AS (SELECT doc_id, pos, regexp_replace(regexp_replace(raw, '[.,:;!?]+$', ''), '^[.,:;]+', '') AS address FROM a)
  SELECT doc_id, arg_min(address, pos) AS address, count(*) AS occurrences FROM c GROUP BY doc_id, lower(address)""")
def email_extract(spark, sf):
    out = M.extract_emails(X.email_text(spark, sf), "doc_id")
    return as_long(out.select("doc_id", "address", "occurrences"))


@query("email_validate", f"WITH {ADDR} SELECT doc_id, address, {_VALID} AS valid FROM addr")
def email_validate(spark, sf):
    return M.validate_emails(X.addresses(spark, sf)).select("doc_id", "address", "valid")


@query("email_domain_signals", _only(DOMAIN_RULES))
def email_domain_signals(spark, sf):
    v = _valid_addresses(spark, sf)
    return v.select("doc_id", signal_ids(M.email_domain_signals(F.col("domain"), F.col("registrable"), F.lit("example.com"))).alias("signals"))


@query("email_local_signals", _only(LOCAL_RULES))
def email_local_signals(spark, sf):
    v = _valid_addresses(spark, sf).withColumn("brand", M.find_brand(F.col("local")))
    return v.select("doc_id", signal_ids(M.email_local_signals(F.col("local"), F.col("registrable"), F.col("brand"))).alias("signals"))


@query("email_display_signals", _only(DISPLAY_RULES))
def email_display_signals(spark, sf):
    v = _valid_addresses(spark, sf).withColumn("brand", M.find_brand(blank("display_name")))
    shown = F.when(F.col("display_name").contains("@"), F.lit("paypal.com"))
    return v.select("doc_id", signal_ids(M.email_display_signals(F.col("display_name"), F.col("registrable"), shown, F.col("brand"))).alias("signals"))


_ALL_IDS, _ALL_WS = _lists([("dom = 'paypa1.com'", "homoglyph", 50), *DOMAIN_RULES, *LOCAL_RULES, *DISPLAY_RULES], "valid")
_ASSESSED = f"""{ADDR}, v AS (SELECT *, {_VALID} AS valid FROM addr), w AS (SELECT *, CASE WHEN valid THEN {_ALL_WS} ELSE [100] END AS ws FROM v),
  j AS (SELECT *, {O.noisy('ws', 99)} AS risk FROM w), a AS (SELECT doc_id, page_id, position, address, risk, CASE WHEN risk >= 30 THEN 'suspicious' WHEN valid AND {_REG} = 'example.com' THEN 'matches-site' ELSE 'external' END AS status,
  CASE WHEN NOT valid THEN 'other-domain' WHEN {_REG} IN {names(P.DISPOSABLE_DOMAINS)} THEN 'disposable' WHEN {_FREE} THEN 'free-provider' WHEN {_REG} = 'example.com' THEN 'same-site' ELSE 'other-domain' END AS category FROM j)"""


def _assessed(spark, sf):
    a = X.addresses(spark, sf).withColumns({"obfuscated": F.lit(False), "page": F.lit("https://www.example.com/x")})
    return M.assess_emails(a, "page")


@query("email_assess", f"WITH {_ASSESSED} SELECT doc_id, address, risk, status, category FROM a")
def email_assess(spark, sf):
    return as_long(_assessed(spark, sf).select("doc_id", "address", F.col("risk_score").alias("risk"), "status", "category"))


@query("email_summary", f"""WITH {_ASSESSED} SELECT page_id, count(*) AS total, count(*) FILTER (status = 'suspicious') AS suspicious, count(*) FILTER (status = 'external') AS external, count(*) FILTER (status = 'matches-site') AS matches_site,
  count(*) FILTER (category = 'disposable') AS disposable, arg_max(address, struct_pack(a := risk, b := -position)) AS worst_address, max(risk) AS worst_score FROM a GROUP BY page_id""")
def email_summary(spark, sf):
    return as_long(M.summarize_emails(_assessed(spark, sf), "page_id"))


# --- mail ---------------------------------------------------------------------------------------------------


def _mail(spark, sf):
    return H.with_headers(X.mail(spark, sf))


_DOC = "FROM documents"
_CLAIMS = f"""claims AS (SELECT doc_id AS msg_id, 0 AS pos, 'spf' AS method, {X.SPF} AS result, {X.CLAIMED} AS dom, {X.SENDER} AS sender {_DOC} UNION ALL SELECT doc_id, 1, 'dkim', {X.DKIM}, {X.SENDER}, {X.SENDER} {_DOC}
  UNION ALL SELECT doc_id, 2, 'dmarc', {X.DMARC}, {X.SENDER}, {X.SENDER} {_DOC} UNION ALL SELECT doc_id, 3, 'spf', 'softfail', {X.CLAIMED}, {X.SENDER} {_DOC} WHERE doc_id % 4 = 0)"""
_WEIGHT = "CASE concat(method, ':', result) " + " ".join(f"WHEN {q(f'{m}:{r}')} THEN {w}" for m, t in P.AUTH_FAILURE_WEIGHTS.items() for r, w in t.items()) + " END"


@query("header_claims", f"WITH {_CLAIMS} SELECT msg_id, CAST(pos AS BIGINT) AS pos, method, result, dom AS identity_domain FROM claims")
def header_claims(spark, sf):
    return as_long(H.auth_claims(_mail(spark, sf)).select("msg_id", "pos", "method", "result", "identity_domain"))


def _summary(spark, sf):
    m = _mail(spark, sf)
    return H.auth_summary(H.auth_claims(m), m)


def _align(m: str) -> str:
    same = f"{O.reg('dom')} = {O.reg('sender')}"
    return f"CASE WHEN bool_or(method = '{m}' AND result = 'pass' AND {same}) THEN 'aligned' WHEN bool_or(method = '{m}' AND result = 'pass') THEN 'not-aligned' ELSE 'unknown' END AS {m}_alignment"


@query("auth_alignment", f"WITH {_CLAIMS} SELECT msg_id, {_align('spf')}, {_align('dkim')}, {_align('dmarc')} FROM claims GROUP BY msg_id")
def auth_alignment(spark, sf):
    return _summary(spark, sf).select("msg_id", "spf_alignment", "dkim_alignment", "dmarc_alignment")


@query("dmarc_status", f"WITH {_CLAIMS} SELECT msg_id, CASE WHEN bool_or(method = 'dmarc' AND result = 'fail') THEN 'reported-fail' WHEN bool_or(method = 'dmarc' AND result = 'pass') THEN 'reported-pass' ELSE 'reported-inconclusive' END AS dmarc_status FROM claims GROUP BY msg_id")
def dmarc_status(spark, sf):
    return _summary(spark, sf).select("msg_id", "dmarc_status")


_IDENT = f"""ident AS (SELECT doc_id AS msg_id, list_filter([CASE WHEN {X.REPLY} = 'acme@gmail.com' THEN 45 WHEN {O.reg(f"split_part({X.REPLY}, '@', 2)")} <> {O.reg(X.SENDER)} THEN 30 END, CASE WHEN {O.reg(X.CLAIMED)} <> {O.reg(X.SENDER)} THEN 15 END,
  CASE WHEN doc_id % 3 = 1 AND {O.reg(X.SENDER)} <> 'bit.ly' THEN 15 END, CASE WHEN doc_id % 3 = 1 AND 'bit.ly' IN {names(P.URL_SHORTENERS)} THEN 15 END], {O.NOT_NULL}) AS ws {_DOC})"""


def _linked(spark, sf):
    """Mail with the links of its text and of its HTML."""
    m = S.parse_messages(X.mail(spark, sf))
    links = F.array_distinct(F.concat(H.body_links(F.col("plain_text")), F.transform("anchors", lambda a: a["href"])))
    return cut_lineage(m.withColumn("link_urls", links).drop("plain_text", "html", "attachments", "anchors", "images", "forms", "hidden_text", "raw"))


@query("sender_identity", f"WITH {_IDENT} SELECT msg_id, {O.noisy('ws', 99)} AS risk, CAST(len(ws) AS BIGINT) AS signals FROM ident")
def sender_identity(spark, sf):
    return as_long(H.sender_identity(_linked(spark, sf)).select("msg_id", F.col("risk_score").alias("risk"), F.size("signals").alias("signals")))


@query("auth_failure_score", f"""WITH {_CLAIMS}, {_IDENT}, f AS (SELECT msg_id, method, max({_WEIGHT}) AS w FROM claims GROUP BY ALL), g AS (SELECT msg_id, list(w) FILTER (w IS NOT NULL) AS fs FROM f GROUP BY msg_id)
  SELECT ident.msg_id, {O.noisy('list_concat(ws, coalesce(fs, []))', 99)} AS risk FROM ident JOIN g USING (msg_id)""")
def auth_failure_score(spark, sf):
    return as_long(H.header_risk(_linked(spark, sf)).select("msg_id", F.col("risk_score").alias("risk")))


@query("received_route", f"SELECT doc_id AS msg_id, 0::BIGINT AS hop, '10.1.2.3,8.8.8.8' AS ips {_DOC} UNION ALL SELECT doc_id, 1, '2001:db8::1' {_DOC}")
def received_route(spark, sf):
    return as_long(H.received_hops(_mail(spark, sf)).select("msg_id", "hop", F.array_join("ips", ",").alias("ips")))


_SEE = f"concat('See https://www.', {X.SENDER}, '/a.', chr(13), chr(10), text)"
_PLAIN = f"CASE doc_id % 3 WHEN 0 THEN len({_SEE}) WHEN 1 THEN 0 ELSE len(concat(text, ' https://www.', {X.SENDER}, '/b,')) END"


@query("src_mail", f"""SELECT doc_id AS msg_id, concat('"News Desk" <news@', {X.SENDER}, '>') AS from_header, CAST({_PLAIN} AS BIGINT) AS text_length,
  CAST(CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS attachments, CASE WHEN doc_id % 9 = 0 THEN 'invalid base64 data' ELSE '' END AS error {_DOC}""")
def src_mail(spark, sf):
    m = S.parse_messages(X.mail(spark, sf))
    return as_long(m.select("msg_id", "from_header", F.length("plain_text").alias("text_length"), F.size("attachments").alias("attachments"), blank("error").alias("error")))


@query("mail_links", f"""SELECT doc_id AS msg_id, concat('https://bit.ly/', CAST(doc_id AS VARCHAR)) AS url, 'href' AS source, true AS mismatch {_DOC} WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 'https://img.example.org/x.png', 'image', false {_DOC} WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'https://evil.example.net/f', 'form', false {_DOC} WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, concat('https://www.', {X.SENDER}, CASE doc_id % 3 WHEN 0 THEN '/a' ELSE '/b' END), 'body', false {_DOC} WHERE doc_id % 3 <> 1
  UNION ALL SELECT doc_id, unnest([concat('https://bit.ly/', CAST(doc_id AS VARCHAR)), 'https://example.com/pay', 'https://img.example.org/x.png', 'https://evil.example.net/f']), 'body', false {_DOC} WHERE doc_id % 3 = 1""")
def mail_links(spark, sf):
    return H.mail_links(S.parse_messages(X.mail(spark, sf))).select("msg_id", "url", "source", F.coalesce("mismatch", F.lit(False)).alias("mismatch"))


@query("attachment_inventory", f"""WITH a AS (SELECT doc_id, sha256(from_base64('UERGREFUQQ==')) AS sha256, octet_length(from_base64('UERGREFUQQ==')) AS size, concat('f', CAST(doc_id % 7 AS VARCHAR), '.pdf') AS filename {_DOC} WHERE doc_id % 3 = 0 AND doc_id % 9 <> 0)
  SELECT sha256, count(*) AS copies, count(DISTINCT doc_id) AS messages, max(size) AS size, min(filename) AS filename, 'unknown' AS status FROM a GROUP BY sha256""")
def attachment_inventory(spark, sf):
    from threatlake.sources.feeds import load_feeds

    inv = S.attachment_inventory(S.parse_messages(X.mail(spark, sf)), load_feeds(spark).hashes)
    return as_long(inv.select("sha256", "copies", "messages", "size", "filename", F.col("hash_status").alias("status")))


_NOTE = "'Note ', CAST(doc_id AS VARCHAR), chr(10)"
_MODEL_TEXT = f"""CASE doc_id % 3 WHEN 0 THEN concat({_NOTE}, {_SEE}, chr(10), 'https://www.', {X.SENDER}, '/a')
  WHEN 1 THEN concat({_NOTE}, 'secret', chr(10), 'https://bit.ly/', CAST(doc_id AS VARCHAR))
  ELSE concat({_NOTE}, text, ' https://www.', {X.SENDER}, '/b,', chr(10), 'https://www.', {X.SENDER}, '/b') END"""


@query("mail_model_text", f"SELECT doc_id AS msg_id, len({_MODEL_TEXT}) AS chars, sha256({_MODEL_TEXT}) AS digest {_DOC}")
def mail_model_text(spark, sf):
    m = S.parse_messages(X.mail(spark, sf))
    links = F.array_distinct(F.concat(H.body_links(F.col("plain_text")), F.transform("anchors", lambda a: a["href"])))
    text = H.model_text(m)
    return as_long(m.withColumn("link_urls", links).select("msg_id", F.length(text).alias("chars"), F.sha2(text, 256).alias("digest")))


# --- intelligence ------------------------------------------------------------------------------------------

_DNS = f"dns AS ({X.DNS_ANSWERS.format(pages='pages')})"
_FACTS = f"""{_DNS}, facts AS (SELECT domain, bool_or(status = 3) FILTER (query = 'MX') AS nxdomain, bool_or(query = 'MX' AND type = 15 AND data <> '0 .') AS has_mx, bool_or(query = 'MX' AND type = 15) AND NOT bool_or(query = 'MX' AND type = 15 AND data <> '0 .') AS null_mx,
  bool_or(query = 'A' AND type = 1) AS resolves, bool_or(coalesce(type = 16, false) AND contains(data, 'v=spf1')) FILTER (query = 'TXT' AND status <> 2) AS has_spf,
  max(CASE WHEN query = 'TXT' AND status = 0 THEN CASE WHEN contains(data, '+all') THEN '+all' WHEN contains(data, '-all') THEN '-all' WHEN data = 'v=spf1 all' THEN '+all' END END) AS spf_all,
  bool_or(query = 'DMARC' AND status = 0 AND data LIKE 'v=DMARC1%') AS has_dmarc, max(CASE WHEN query = 'DMARC' AND status = 0 AND data LIKE '%p=Reject%' THEN 'reject' END) AS dmarc_policy,
  max(CASE WHEN query = 'MX' AND type = 15 THEN CASE WHEN contains(data, 'google') THEN 'Google Workspace / Gmail' WHEN contains(data, 'outlook') THEN 'Microsoft 365 / Outlook' END END) AS provider FROM dns GROUP BY domain),
  f2 AS (SELECT domain, coalesce(nxdomain, false) AS nxdomain, coalesce(has_mx, false) AS has_mx, coalesce(null_mx, false) AS null_mx, coalesce(resolves, false) AS resolves, has_spf, spf_all, coalesce(has_dmarc, false) AS has_dmarc, dmarc_policy, provider FROM facts)"""


@query("dns_facts", f"WITH {_FACTS} SELECT domain, nxdomain, has_mx, null_mx, resolves, coalesce(CAST(has_spf AS VARCHAR), 'unknown') AS has_spf, coalesce(spf_all, '') AS spf_all, has_dmarc, coalesce(dmarc_policy, '') AS dmarc_policy FROM f2")
def dns_facts(spark, sf):
    f = I.dns_facts(X.dns_answers(spark, sf))
    return f.select("domain", "nxdomain", "has_mx", "null_mx", "resolves", F.coalesce(F.col("has_spf").cast("string"), F.lit("unknown")).alias("has_spf"),
                    blank("spf_all").alias("spf_all"), "has_dmarc", blank("dmarc_policy").alias("dmarc_policy"))


@query("mx_provider", f"WITH {_FACTS} SELECT domain, coalesce(provider, '') AS provider FROM f2")
def mx_provider(spark, sf):
    return I.dns_facts(X.dns_answers(spark, sf)).select("domain", blank(I.mx_provider(F.col("mx_hosts"))).alias("provider"))


@query("dmarc_inherit", f"""WITH {_FACTS}, all_f AS (SELECT domain, has_dmarc, dmarc_policy FROM f2 UNION ALL SELECT concat('sub.', domain, '.org'), false, NULL FROM f2 UNION ALL SELECT 'com.org', true, 'none')
  SELECT domain, has_dmarc OR domain LIKE '%com.org' AS has_dmarc, coalesce(CASE WHEN domain LIKE '%com.org' THEN 'none' ELSE dmarc_policy END, '') AS dmarc_policy FROM all_f""")
def dmarc_inherit(spark, sf):
    f = I.dns_facts(X.dns_answers(spark, sf)).select("domain", "has_dmarc", "dmarc_policy")
    subs = f.select(F.concat(F.lit("sub."), F.col("domain"), F.lit(".org")).alias("domain"), F.lit(False).alias("has_dmarc"), F.lit(None).cast("string").alias("dmarc_policy"))
    org = f.agg(F.lit("com.org").alias("domain"), F.lit(True).alias("has_dmarc"), F.lit("none").alias("dmarc_policy"))
    return I.inherit_dmarc(f.unionByName(subs).unionByName(org)).select("domain", "has_dmarc", blank("dmarc_policy").alias("dmarc_policy"))


_AGE = "CAST(greatest(0, floor((epoch(TIMESTAMP '2024-09-20 12:00:00') - epoch(make_timestamp(2024, CAST(1 + page_id % 9 AS BIGINT), CAST(10 + page_id % 10 AS BIGINT), 5, 6, 7.0))) / 86400)) AS BIGINT)"
_AS_OF = "2024-09-20 12:00:00"


def _ages(spark, sf):
    raw = X.tables(spark, sf, "pages")["pages"].select(
        "page_id", F.concat(F.lit("d"), F.col("page_id").cast("string"), F.lit(".example.com")).alias("domain"),
        F.concat(F.lit('{"events":[{"eventAction":"last changed","eventDate":"2025-01-01T00:00:00Z"},{"eventAction":"registration","eventDate":"2024-0'),
                 (1 + F.col("page_id") % 9).cast("string"), F.lit("-1"), (F.col("page_id") % 10).cast("string"), F.lit('T05:06:07Z"}]}')).alias("payload"))
    return I.with_age(I.parse_registrations(raw), _AS_OF)


@query("src_registry", f"SELECT concat('d', CAST(page_id AS VARCHAR), '.example.com') AS domain, epoch_us(make_timestamp(2024, CAST(1 + page_id % 9 AS BIGINT), CAST(10 + page_id % 10 AS BIGINT), 5, 6, 7.0)) AS registered_us FROM pages")
def src_registry(spark, sf):
    return _ages(spark, sf).select("domain", F.unix_micros("registered_at").alias("registered_us"))


@query("domain_age", f"SELECT concat('d', CAST(page_id AS VARCHAR), '.example.com') AS domain, {_AGE} AS age_days, CAST(CASE WHEN {_AGE} <= 7 THEN 40 WHEN {_AGE} <= 30 THEN 28 WHEN {_AGE} <= 90 THEN 10 ELSE 0 END AS BIGINT) AS weight FROM pages")
def domain_age(spark, sf):
    a = _ages(spark, sf)
    return as_long(a.select("domain", "age_days", F.coalesce(F.get(I.url_age_signal(F.col("age_days")), F.lit(0))["weight"], F.lit(0)).alias("weight")))


_INTEL = f"{_FACTS}, age AS (SELECT concat('d', CAST(page_id AS VARCHAR), '.example.com') AS domain, {_AGE} AS age FROM pages)"
_ISIG = [
    ("nxdomain", "online-domain-not-found"), ("NOT nxdomain AND (null_mx OR (NOT has_mx AND NOT resolves))", "online-no-mail-server"),
    ("NOT nxdomain AND NOT has_spf AND NOT has_dmarc", "online-no-email-auth"), ("NOT nxdomain AND spf_all = '+all'", "online-spf-allows-all"), ("age <= 90", "online-new-domain"),
]


@query("domain_intel_signals", f"WITH {_INTEL} SELECT domain, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {q(i)} END' for c, i in _ISIG)}], {O.NOT_NULL}), ',') AS signals FROM f2 JOIN age USING (domain)")
def domain_intel_signals(spark, sf):
    f = I.dns_facts(X.dns_answers(spark, sf)).join(_ages(spark, sf), "domain")
    return f.select("domain", signal_ids(I.domain_intel_signals(True)).alias("signals"))


@query("domain_enrich", f"WITH {_INTEL}, v AS (SELECT event_id AS seq, concat('d', CAST(event_id % 300 AS VARCHAR), '.example.com') AS domain FROM events) SELECT seq, v.domain, coalesce(provider, '') AS provider, f2.domain IS NOT NULL AS known FROM v LEFT JOIN f2 ON v.domain = f2.domain")
def domain_enrich(spark, sf):
    v = X.tables(spark, sf, "events")["events"].select(F.col("event_id").alias("seq"), F.concat(F.lit("d"), (F.col("event_id") % 300).cast("string"), F.lit(".example.com")).alias("name"))
    out = I.with_domain_intel(v, "name", I.dns_facts(X.dns_answers(spark, sf)), _ages(spark, sf).select("domain", "registered_at"), _AS_OF)
    return out.select("seq", F.col("name").alias("domain"), blank("mail_provider").alias("provider"), F.col("has_mx").isNotNull().alias("known"))


@query("rdap_service", f"WITH {O.PARTS} SELECT DISTINCT host AS domain, CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'https://special.test/' WHEN host LIKE '%.com' THEN 'https://com.test/' ELSE 'https://org.test/' END AS base FROM p3 WHERE url_valid AND (host LIKE '%.com' OR host LIKE '%.org')")
def rdap_service(spark, sf):
    boot = spark.createDataFrame([("com", ["http://plain.test/", "https://com.test/"], 0), ("ORG", ["https://org.test/"], 1), ("example.com", ["https://special.test/"], 2), ("net", ["http://only.test/"], 3)], "ending string, urls array<string>, pos int")
    hosts = U.with_url_parts(X.urls(spark, sf)).where("url_valid").select(F.col("host").alias("domain"))
    return I.rdap_base(hosts, boot)


@query("normalize_emails", f"WITH {ADDR}, k AS (SELECT page_id, lower(address) AS lookup_key, min(position) AS p FROM addr WHERE {_VALID} GROUP BY ALL) SELECT page_id, lookup_key FROM k")
def normalize_emails(spark, sf):
    return I.email_lookup_keys(X.addresses(spark, sf), "page_id").select("page_id", "lookup_key")


@query("normalize_urls", f"WITH {O.PARTS}, n AS (SELECT user_id, page_id, concat(scheme, '://', host, CASE WHEN port <> '' THEN concat(':', port) ELSE '' END, path, regexp_extract(url, '([?#].*)$', 1)) AS u FROM p3 WHERE url_valid AND NOT has_at), k AS (SELECT user_id, u, min(page_id) AS p FROM n GROUP BY ALL) SELECT user_id, u AS lookup_url FROM k")
def normalize_urls(spark, sf):
    return I.url_lookup_keys(X.urls(spark, sf), "user_id", order="page_id").select("user_id", "lookup_url")


def _payloads(spark, sf):
    d = F.col("doc_id")
    flag = lambda n, k: F.concat(F.lit(f'"{n}":'), (d % k == 0).cast("string"))
    body = F.concat(F.lit('{"reputation":"low","suspicious":'), (d % 4 == 0).cast("string"), F.lit(',"references":3,"details":{'),
                    F.concat_ws(",", flag("malicious_activity", 7), flag("blacklisted", 11), flag("spam", 5), flag("credentials_leaked", 3), flag("disposable", 13), flag("domain_exists", 2)),
                    F.lit(',"days_since_domain_creation":'), (d % 60).cast("string"), F.lit("}}"))
    return X.tables(spark, sf, "documents")["documents"].select(d.alias("doc_id"), F.concat(F.lit("u"), d.cast("string"), F.lit("@example.com")).alias("address"), body.alias("payload"))


_RSIG = [("doc_id % 4 = 0", "online-email-suspicious"), ("doc_id % 7 = 0", "online-malicious-activity"), ("doc_id % 11 = 0", "online-email-blocklisted"), ("doc_id % 5 = 0", "online-email-spam"),
         ("doc_id % 3 = 0", "online-credentials-leaked"), ("doc_id % 13 = 0", "online-disposable-provider"), ("doc_id % 2 = 1", "online-domain-not-found"), ("doc_id % 60 <= 30", "online-new-domain")]
_REPS = f"list_filter([{', '.join(f'CASE WHEN {c} THEN {q(i)} END' for c, i in _RSIG)}], {O.NOT_NULL})"


@query("email_rep_signals", f"SELECT concat('u', CAST(doc_id AS VARCHAR), '@example.com') AS address, array_to_string({_REPS}, ',') AS signals FROM documents")
def email_rep_signals(spark, sf):
    return I.parse_email_reputation(_payloads(spark, sf)).select("address", signal_ids(I.email_rep_signals()).alias("signals"))


@query("rep_report", f"""SELECT concat('u', CAST(doc_id AS VARCHAR), '@example.com') AS address, CASE WHEN doc_id % 5 < 3 AND doc_id % 2 = 0 THEN 'complete' WHEN doc_id % 5 < 3 OR doc_id % 2 = 0 THEN 'partial' ELSE 'unavailable' END AS report_status,
  CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 ELSE doc_id % 60 END AS BIGINT) AS report_age FROM documents""")
def rep_report(spark, sf):
    d = F.regexp_extract("address", r"(\d+)", 1).cast("bigint")
    r = I.parse_email_reputation(_payloads(spark, sf)).withColumns({
        "rep_available": d % 5 < 3, "has_mx": F.when(d % 2 == 0, F.lit(True)), "has_spf": F.lit(None).cast("boolean"), "has_dmarc": F.lit(None).cast("boolean"),
        "nxdomain": F.lit(False), "null_mx": F.lit(False), "resolves": F.lit(True), "spf_all": F.lit("-all"), "age_days": F.when(d % 3 == 0, (d % 100).cast("int"))})
    return as_long(I.rep_report(r).select("address", "report_status", "report_age"))


@query("enrich_gate", f"WITH {O.VERDICT} SELECT page_id, score >= 15 AND score < 60 AS borderline FROM verdict")
def enrich_gate(spark, sf):
    return U.scan_urls(X.urls(spark, sf)).select("page_id", I.needs_enrichment(F.col("score")).alias("borderline"))


@query("url_listing_join", f"WITH {O.VERDICT}, w AS (SELECT page_id, score AS local_score, list_concat(ws, list_filter([CASE WHEN page_id % 3 = 0 THEN 55 END, CASE WHEN page_id % 5 = 0 THEN 55 END], {O.NOT_NULL})) AS w2 FROM verdict) SELECT page_id, local_score, {O.noisy('w2')} AS score, CASE WHEN page_id % 3 = 0 THEN 'listed' ELSE 'unknown' END AS urlhaus_status FROM w")
def url_listing_join(spark, sf):
    u = X.urls(spark, sf).drop("html")
    scanned = U.scan_urls(u).withColumn("list_key", F.col("page_id").cast("string"))
    listings = u.select(F.col("page_id").cast("string").alias("url"), F.explode(F.array_compact(F.array(
        F.when(F.col("page_id") % 3 == 0, F.lit("urlhaus")), F.when(F.col("page_id") % 5 == 0, F.lit("phishTank"))))).alias("provider"), F.lit("listed").alias("status"), F.lit("phish").alias("detail"))
    return as_long(I.with_url_listings(scanned, listings, "list_key").select("page_id", "local_score", "score", "urlhaus_status"))


# --- models and detectors -------------------------------------------------------------------------------------


@query("fuse_model", f"WITH {O.VERDICT}, w AS (SELECT page_id, score, list_concat(ws, [CAST(page_id % 100 AS INT)]) AS w2 FROM verdict) SELECT page_id, greatest(score, {O.noisy('w2')}) AS score FROM w")
def fuse_model(spark, sf):
    v = U.scan_urls(X.urls(spark, sf)).withColumn("probability", (F.col("page_id") % 100) / F.lit(100.0))
    return as_long(I.fuse_model(v).select("page_id", "score"))


@query("explain_trigger", f"WITH {O.VERDICT} SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'user-request' WHEN score >= 30 THEN 'risk-threshold' ELSE 'not-triggered' END AS trigger FROM verdict")
def explain_trigger(spark, sf):
    intent = F.when(F.col("page_id") % 4 == 0, "explain").otherwise("automatic")
    return U.scan_urls(X.urls(spark, sf)).select("page_id", I.explain_trigger(F.col("score"), intent).alias("trigger"))


_HELD_OUT = "doc_id % 5 = 0"


def _labelled(spark, sf):
    t = X.tables(spark, sf, "documents", "labels")
    return t["documents"].join(t["labels"], "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("label"))


_REPORT = "support, precision >= 0.9 AS precise, recall >= 0.9 AS recalled"


@query("train_text_model", f"SELECT CAST(toxic AS DOUBLE) AS class, count(*) AS support, true AS ranked FROM documents JOIN labels USING (doc_id) WHERE {_HELD_OUT} AND toxic IS NOT NULL GROUP BY ALL")
def train_text_model(spark, sf):
    """Train on four fifths of the labelled documents; report of the others, which must be ranked well above chance."""
    data = cut_lineage(_labelled(spark, sf).where("label IS NOT NULL"))
    model = ml.fit_text_model(data.where(f"NOT ({_HELD_OUT})"))
    held = data.where(_HELD_OUT)
    return ml.text_report(model, held).select("class", "support", F.lit(ml.ranking(model, held) >= 0.75).alias("ranked"))


@query("score_text_model", f"SELECT doc_id, true AS same_by_terms, true AS in_band FROM documents WHERE {_HELD_OUT}")
def score_text_model(spark, sf):
    """Held-out documents, scored by the pipeline and as a sparse product of term weights: both must give one probability and its band."""
    model = ml.fit_text_model(cut_lineage(_labelled(spark, sf).where(f"label IS NOT NULL AND NOT ({_HELD_OUT})")))
    docs = X.tables(spark, sf, "documents")["documents"].where(_HELD_OUT).select("doc_id", "text")
    scored = ml.score_text(docs, model).select("doc_id", "probability", "prediction", "risk")
    terms = model.probability_by_terms(docs, "doc_id").withColumnRenamed("probability", "_p")
    low, high = P.MODEL_BANDS
    band = F.when(F.col("_p") < low, "LOW").when(F.col("_p") < high, "SUSPICIOUS").otherwise("HIGH")
    near = (F.abs(F.col("_p") - low) < 1e-4) | (F.abs(F.col("_p") - high) < 1e-4)  # rounding may move these over an edge
    empty = F.col("risk") == "UNKNOWN"
    return scored.join(terms, "doc_id").select(
        "doc_id", (empty | (F.abs(F.col("probability") - F.col("_p")) < 1e-4)).alias("same_by_terms"), (empty | near | (F.col("risk") == band)).alias("in_band"))


@query("train_url_model", f"WITH {O.VERDICT} SELECT CASE WHEN score >= 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS class, count(*) AS support, true AS precise, true AS recalled, true AS same_by_nodes FROM verdict WHERE page_id % 5 = 0 AND host <> '' GROUP BY ALL")
def train_url_model(spark, sf):
    """200 boosted trees that learn the rule verdict from the sixteen features; held-out class report from the node table, which must predict as
    the fitted model does."""
    v = with_verdict(U.url_signals(X.urls(spark, sf), keep=True)).where("url_valid")
    data = cut_lineage(v.select("page_id", *P.FEATURE_ORDER, (F.col("score") >= 30).cast("int").alias("label")))
    held = F.col("page_id") % 5 == 0
    model, report = ml.fit_url_model(data, held_out=held)
    rows = ml.feature_vector(data.where(held)).select("features", *P.FEATURE_ORDER)
    other = ml.score_url(model, rows).withColumnRenamed("prediction", "_nodes").withColumnRenamed("probability", "_p")
    wrong = model.transform(other).where("prediction <> _nodes").agg((F.count(F.lit(1)) == 0).alias("same_by_nodes"))
    return report.selectExpr("class", *_REPORT.split(", ")).join(F.broadcast(wrong))  # one row


def _registry() -> R.DetectorRegistry:
    from threatlake.functions.signals import signal, signal_if, signals_of

    http = lambda df, c: df.withColumn(c, signals_of(signal_if(F.col("url").startswith("http:"), "plain-http", 10, "not encrypted")))
    loud = lambda df, c: df.withColumn(c, signals_of(signal_if(F.col("text").contains("!"), "loud", 5, "exclamation")))
    bad = lambda df, c: df.withColumn(c, F.when(F.col("page_id") % 7 == 0, signals_of(signal("broken", 500, "weight out of range"))).otherwise(signals_of()))
    return R.DetectorRegistry().register("http", ["url", "page"], http).register("loud", ["text", "page"], loud).register("bad", ["url", "text", "page"], bad)


def _inputs(spark, sf):
    k = F.col("page_id") % 4
    return X.tables(spark, sf, "pages")["pages"].select(
        "page_id", F.when(k == 0, "url").when(k == 1, "text").when(k == 2, "page").otherwise("other").alias("kind"),
        F.when(F.col("page_id") % 9 != 0, F.col("url")).alias("url"), F.concat(F.lit("page "), F.when(F.col("page_id") % 2 == 0, "!").otherwise("")).alias("text"))


_GOOD = "page_id % 4 = 1 OR (page_id % 4 IN (0, 2) AND page_id % 9 <> 0)"
_KIND = "CASE page_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'text' WHEN 2 THEN 'page' ELSE 'other' END"


@query("detector_registry", f"SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 4 IN (0, 2) AND url LIKE 'http:%' THEN 'plain-http' END, CASE WHEN page_id % 4 IN (1, 2) AND page_id % 2 = 0 THEN 'loud' END], {O.NOT_NULL}), ',') AS signals FROM pages WHERE {_GOOD}")
def detector_registry(spark, sf):
    return _registry().scan(R.input_guard(_inputs(spark, sf))[0]).select("page_id", signal_ids("signals").alias("signals"))


@query("signal_guard", f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'bad' ELSE '' END AS failures FROM pages WHERE {_GOOD}")
def signal_guard(spark, sf):
    return _registry().scan(R.input_guard(_inputs(spark, sf))[0]).select("page_id", F.array_join("failures", ",").alias("failures"))


@query("input_guard", f"SELECT page_id, {_KIND} AS kind FROM pages WHERE NOT ({_GOOD})")
def input_guard(spark, sf):
    return R.input_guard(_inputs(spark, sf))[1].select("page_id", "kind")


# --- plans -----------------------------------------------------------------------------------------------------


@query("threat_timeline")
def threat_timeline(spark, sf):
    from threatlake.plans.timeline import threat_timeline as plan
    from threatlake.sources.feeds import load_feeds

    t = plan(put_down(E.observed(spark, sf)), load_feeds(spark), 3600, E.GAP)
    return as_long(t.select("id", "host", "event_type", "severity", "score", "repeat_count"))


# --- streams (each runs over the given events in several micro-batches, out of order) -------------------------------

CHUNKS = 3


def _stream(spark, rows, ts="ts", last=None):
    """``rows`` as a stream of CHUNKS micro-batches and a heartbeat, and the delay in seconds that covers their disorder: rows arrive up to half a
    micro-batch late. The heartbeat is at ``last``, or a year after the newest row."""
    from math import ceil
    from uuid import uuid4

    from threatlake.session import ensure_checkpoint_dir
    from threatlake.streaming.ordered import HEARTBEAT

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    rows.write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    lo, hi = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    width = ceil(((hi or 0) - (lo or 0) + 1) / CHUNKS)
    late = F.pmod(F.xxhash64("seq"), F.lit(max(1, width // 2)))
    arrival = F.least(F.floor((F.unix_micros(ts) + late - F.lit(lo)) / width), F.lit(CHUNKS - 1))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for i in range(CHUNKS):
        rows.where(arrival == i).repartition(parts).write.mode("append").parquet(f"{base}/in")
    delay = ceil(1.5 * width / 1_000_000) + 1
    beat = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    at = last(hi, delay) if last else (hi or 0) + (365 * 86400 + delay) * 1_000_000
    beat = beat.withColumns({ts: F.timestamp_micros(F.lit(at)), "event_type": F.lit(HEARTBEAT)})
    beat.select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(f"{base}/in"), delay, base


def _finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def _ordered(spark, start, base, columns):
    """Run an ordered stream to its end and read its output."""
    _finish(start)
    return spark.read.parquet(f"{base}/out").select(*columns)


def _drain(df, spark, base):
    """Run a stream to its end into the shared folder and read the result."""
    _finish(df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"))
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("stream_findings", E.O.ALL + " SELECT seq, event_type, array_to_string(ids, ',') AS rules, score FROM scored")
def stream_findings(spark, sf):
    from threatlake.functions.findings import rule_ids
    from threatlake.sources.feeds import load_feeds
    from threatlake.streaming import operators as ST

    events, delay, base = _stream(spark, X.telemetry(spark, sf))
    out = _ordered(spark, ST.stream_findings(events, load_feeds(spark), f"{base}/run", delay, E.monitored), f"{base}/run", ["seq", "event_type", "findings", "score"])
    return as_long(out.select("seq", "event_type", rule_ids("findings").alias("rules"), "score"))


@query("stream_cooldown", E.O.ALL.replace("WITH ", "WITH RECURSIVE ", 1) + E._LONG + E._RECURSE + " SELECT seq, CAST(pos AS BIGINT) AS pos, emitted FROM r")
def stream_cooldown(spark, sf):
    from threatlake.streaming import operators as ST

    ST.use_rocksdb(spark)
    judged = E.judged(spark, sf).where(~F.col("event_type").rlike("^(startup_item|scheduled_task|service)_"))
    judged = judged.select("seq", "host", "ts", "event_type", *dedup.NAMING, RULES)
    events, delay, base = _stream(spark, judged)
    return as_long(_drain(ST.stream_cooldown(events, E._DAY, f"{delay} seconds"), spark, base).select("seq", "pos", "emitted"))


@query("stream_conn_stats", f"WITH {E.O.TELE}, {E.O.GEN}, {E.O.STATS} SELECT seq, connection_count, unique_destinations FROM net")
def stream_conn_stats(spark, sf):
    from threatlake.streaming import operators as ST

    events, delay, base = _stream(spark, X.telemetry(spark, sf))
    return _ordered(spark, ST.stream_conn_stats(events, f"{base}/run", delay), f"{base}/run", ["seq", "connection_count", "unique_destinations"])


@query("stream_download_corr", E._ASOF + E._CALLS + """ SELECT seq, 'CORR_DOWNLOAD_PROCESS_EXECUTION' AS rule_id, download_seq FROM x WHERE download_seq IS NOT NULL
  UNION ALL SELECT seq, 'CORR_DOWNLOAD_OUTBOUND_CONN', download_seq FROM n WHERE download_seq IS NOT NULL""")
def stream_download_corr(spark, sf):
    from threatlake.streaming import operators as ST

    events, delay, base = _stream(spark, X.telemetry(spark, sf))
    return _ordered(spark, ST.stream_download_corr(events, f"{base}/run", delay), f"{base}/run", ["seq", "rule_id", "download_seq"])


@query("stream_compact", E._STORE + f" SELECT {E._STORE_COLS} FROM store")
def stream_compact(spark, sf):
    from threatlake.operators.store import stored_form
    from threatlake.streaming import operators as ST

    ST.use_rocksdb(spark)
    events, delay, base = _stream(spark, stored_form(E.judged(spark, sf)))
    return E._store_row(_drain(ST.stream_compact(events, E.GAP, f"{delay} seconds"), spark, base))


@query("stream_allow_once", """WITH v AS (SELECT event_id AS seq, ts, user_id, CASE WHEN event_type IN ('click', 'signup') THEN 'approve' ELSE 'visit' END AS kind, event_id % 3 AS site FROM events),
  w AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, site ORDER BY ts, seq) AS before FROM v) SELECT seq, coalesce(before = 'approve', false) AS allowed FROM w WHERE kind = 'visit'""")
def stream_allow_once(spark, sf):
    from threatlake.streaming import operators as ST

    raw = X.tables(spark, sf, "events")["events"]
    visits = raw.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
                        F.when(F.col("event_type").isin("click", "signup"), "approve").otherwise("visit").alias("kind"),
                        F.concat(F.lit("https://site"), (F.col("event_id") % 3).cast("string"), F.lit(".example.com/#a")).alias("url"))
    events, delay, base = _stream(spark, visits)
    return _ordered(spark, ST.stream_allow_once(events, f"{base}/run", delay), f"{base}/run", ["seq", "allowed"])


_PERIOD = 4 * 86400
_SNAPSHOTS = f"""SELECT host, pid, (epoch_us(ts) // {_PERIOD}000000) * {_PERIOD}000000 AS epoch, max(seq // 20) AS life FROM tele WHERE event_type = 'process_started' AND pid % 4 <> (epoch_us(ts) // {_PERIOD}000000) % 4 GROUP BY ALL"""


@query("stream_snapshot_diff", f"""WITH {E.O.TELE}, s AS ({_SNAPSHOTS}), top AS (SELECT max(epoch) AS last FROM s),
  w AS (SELECT *, lag(epoch) OVER o AS before, lag(life) OVER o AS old, lead(epoch) OVER o AS after FROM s WINDOW o AS (PARTITION BY host, pid ORDER BY epoch))
  SELECT host, pid, epoch, 'process_started' AS event_type, life FROM w WHERE before IS NULL OR before < epoch - {_PERIOD}000000 OR old <> life
  UNION ALL SELECT host, pid, epoch, 'process_terminated', old FROM w WHERE before = epoch - {_PERIOD}000000 AND old <> life
  UNION ALL SELECT host, pid, epoch + {_PERIOD}000000, 'process_terminated', life FROM w, top WHERE epoch < last AND (after IS NULL OR after > epoch + {_PERIOD}000000)""")
def stream_snapshot_diff(spark, sf):
    """Snapshots every four days of the processes started since the last one; some are missing from some, and a later start reuses the pid."""
    from threatlake.streaming import operators as ST

    ST.use_rocksdb(spark)
    ev = X.telemetry(spark, sf).where(F.col("event_type") == "process_started")
    number = F.floor(F.unix_micros("ts") / (_PERIOD * 1_000_000))
    seen = ev.where(F.pmod("pid", F.lit(4)) != F.pmod(number, F.lit(4))).groupBy("host", "pid", number.alias("_n")).agg(F.max(F.floor(F.col("seq") / 20)).alias("create_time"))
    snapshots = seen.select("host", "pid", F.timestamp_micros(F.col("_n") * _PERIOD * 1_000_000).alias("snapshot_ts"), "create_time",
                            F.col("pid").alias("seq"), F.lit("process_observed").alias("event_type"))
    events, delay, base = _stream(spark, snapshots, "snapshot_ts", last=lambda hi, delay: hi + delay * 1_000_000 + 2_000_000)
    return _drain(ST.stream_snapshot_diff(events, _PERIOD, f"{delay} seconds"), spark, base)


@query("stream_sink", E._STORE + " SELECT id, score, repeat_count, first_us, last_us FROM store")
def stream_sink(spark, sf):
    from threatlake.operators import upsert
    from threatlake.sources.feeds import load_feeds
    from threatlake.streaming import operators as ST

    events, _, base = _stream(spark, E.observed(spark, sf))
    events = events.where("event_type <> 'heartbeat'")
    _finish(ST.stream_sink(events, load_feeds(spark), f"{base}/store", f"{base}/checkpoint", E.GAP))
    schema = spark.read.parquet(f"{base}/store/arrived/0").schema
    live = upsert.read_live(spark, f"{base}/store", schema)
    return as_long(live.select("id", "score", "repeat_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us")))
